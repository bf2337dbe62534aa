"""Self-join of documents on the Jaccard similarity of their word n-gram sets, by MinHash banding.

1. Documents with the same n-gram set are one node from the start: copies are counted, never compared or paired.
2. Bands of MinHash values are shuffled by their hash. Bands and rows are chosen for a target recall at the threshold.
   Buckets that hold the same nodes are one bucket.
3. The nodes of a bucket of bounded rows and bytes meet in one task, which compares full n-gram sets, each two nodes in
   the first band they share and nowhere else.
4. Larger ("hot") buckets overlap much, as a group of near copies makes one in every band. Each of their nodes has one
   home, the largest hot bucket it is in, and homes are cut into blocks of bounded rows and bytes. Two blocks that meet in
   some hot bucket meet in one task, once for all bands, where pairs that share any hot bucket are compared. A text is
   moved once for each block that its own one meets.
5. A task gives one row per node: the links it found (weighted by copies) and the smallest node that it is joined with.
   Pairs are never written out. Links are summed; classes are the connected components.

The number of links of n near copies asks for n * n / 2 comparisons; blocks make that many in tasks of one size.

Defined results: documents without a word (null texts too) and rows without an id are linked to nothing and are classes
of their own (class_id is their id); a text shorter than an n-gram has one of all its words; rows that repeat, also
under one id, are copies and count as links; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import give_back, map_texts, pick, place_of, removed, slices, written
from pairloom.llm.shingles import mix, shingle_hashes

#: Nodes and bytes of text of a block, about; a tile holds two blocks at most.
BLOCK, BLOCK_BYTES = 768, 8 << 20


def bands_for(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """The most selective (bands, rows) of at most `most_hashes` hashes that find a pair at the threshold with this chance."""
    for rows in range(most_hashes, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no bands of so few hashes reach this recall")


class Sketcher:
    """For texts: the node (a digest of the n-gram set), the set and its band hashes."""

    def __init__(self, size: int, bands: int, rows: int):
        self.size, self.bands, self.rows = size, bands, rows
        rng = np.random.default_rng(11)
        self.factors = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for first, last in slices(np.array([len(t) for t in texts], np.int64), 1_000_000):
            flat, at = shingle_hashes(texts[first:last], self.size)
            out += [np.unique(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    @staticmethod
    def node(own: np.ndarray) -> bytes | None:
        return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None

    @staticmethod
    def mark(node: bytes) -> int:
        return int.from_bytes(node[:8], "little", signed=True)

    def band_hashes(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of band hashes for each set that isn't empty."""
        sizes = np.array([len(s) for s in sets], np.int64)
        parts = [self._band_hashes(sets[a:b], sizes[a:b]) for a, b in slices(sizes, 200_000)]
        return np.concatenate(parts) if parts else np.empty((0, self.bands), np.int64)

    def _band_hashes(self, sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        flat, first = np.concatenate(sets), np.cumsum(sizes) - sizes
        out = np.tile(self.salts, (len(sets), 1))
        with np.errstate(over="ignore"):
            for i, a in enumerate(self.factors):
                x = flat * a
                out[:, i // self.rows] = mix(out[:, i // self.rows] + np.minimum.reduceat(x ^ (x >> np.uint64(32)), first))
        return out.view(np.int64)


@functools.lru_cache(maxsize=8)
def sketcher(size: int, bands: int, rows: int) -> Sketcher:
    return Sketcher(size, bands, rows)


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """key, node (null without a word), mark (the node's first eight bytes), chars, bands of documents (key, text)."""

    def sign(texts):
        s = sketcher(size, bands, rows)
        sets = s.sets(texts)
        full = [x for x in sets if len(x)]
        made = iter(s.band_hashes(full).tolist())
        nodes = [s.node(x) for x in sets]
        return [nodes, [n and s.mark(n) for n in nodes], [len(t) for t in texts], [next(made) if len(x) else None for x in sets]]

    return map_texts(docs, "text", ["key"], [T.StructField("node", T.BinaryType()), T.StructField("mark", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))], sign)


def buckets_of(reps: DataFrame, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """All (rep, mark, copies, chars, band, bucket), and the buckets in which nodes meet: bucket, held, parts.

    parts: into how many blocks a bucket is cut as a home; above 1 the bucket is hot.
    """
    placed = reps.select("rep", "mark", "copies", "chars", F.posexplode("bands").alias("band", "bucket"))
    buckets = placed.groupBy("bucket").agg(F.count("*").alias("held"), F.sum("chars").alias("bytes"), F.bit_xor(F.xxhash64("mark")).alias("who"), F.min("band").alias("first"))
    # equal buckets share their members in every band: the first one stands for all
    kept = buckets.where("held > 1").groupBy("held", "who").agg(F.min(F.struct("first", "bucket")).alias("b"), F.max("bytes").alias("bytes"))
    parts = F.ceil(F.greatest(F.col("held") / block, F.when(F.col("held") > 2, F.col("bytes") / block_bytes).otherwise(F.lit(1.0)))).cast("int")
    return placed, kept.select("b.bucket", "held", parts.alias("parts"))


def tiles_of(placed: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, mark, copies, tile, band, side) of small buckets, and the same of hot ones.

    band: the one of the small bucket, -1 in hot tiles. side: 0 or 1, the block's; -1 if a tile is one block with itself.
    """
    met = placed.join(kept, "bucket")
    small = met.where("parts = 1").select("rep", "mark", "copies", F.xxhash64("bucket").alias("tile"), F.col("band").cast("int").alias("band"), F.lit(-1).alias("side"))
    hot = met.where("parts > 1").select("rep", "mark", "copies", "bucket", "held", "parts")
    home = hot.groupBy("rep", "mark").agg(F.max(F.struct("held", "bucket", "parts")).alias("h"), F.max("copies").alias("copies"))
    own = home.select("rep", "mark", "copies", F.xxhash64("h.bucket", F.pmod(F.xxhash64("mark", "h.bucket"), F.col("h.parts"))).alias("own"))
    # the blocks of each hot bucket, and of those each two that meet
    there = hot.select("rep", "mark", "bucket").join(own.select("rep", "mark", "own"), ["rep", "mark"]).select("bucket", "own").distinct()
    two = there.join(there.withColumnRenamed("own", "other"), "bucket").where("own <= other").select("own", "other").distinct()
    tile = F.xxhash64("own", "other")
    ends = two.select(F.col("own").alias("block"), tile.alias("tile"), F.when(F.col("own") == F.col("other"), -1).otherwise(0).alias("side")).unionByName(two.where("own < other").select(F.col("other").alias("block"), tile.alias("tile"), F.lit(1).alias("side")))
    large = own.join(ends, F.col("own") == F.col("block")).select("rep", "mark", "copies", "tile", F.lit(-1).alias("band"), "side")
    return small, large


def common_counts(sets: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, [a, a + step])
        m = np.zeros((n, min(step, int(shared.sum()) - a)), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    return out


def links_in_tile(nodes: list[bytes], copies: np.ndarray, sides: np.ndarray, band: int, bands: np.ndarray, hot: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[bytes, int, int, bytes]]:
    """(node, linked documents, linked nodes, smallest node it is joined with) of each node that has a link here.

    band: of a small bucket, or -1 in a hot tile. hot: of each node a bit for each band in which it is in a hot bucket.
    """
    sizes = np.array([len(s) for s in sets], np.float32)
    both = common_counts(sets)
    link = both >= np.float32(threshold) * (sizes[:, None] + sizes[None, :] - both) - 1e-3
    near = np.nonzero(link)  # the border is decided in double precision
    exact = both[near].astype(np.float64)
    link[near] = exact >= threshold * (sizes[near[0]].astype(np.float64) + sizes[near[1]] - exact) - 1e-9
    np.fill_diagonal(link, False)
    if sides[0] >= 0:
        link &= sides[:, None] != sides[None, :]
    shared = np.zeros_like(link)  # pairs that meet elsewhere, or, in a hot tile, those that meet in a hot bucket
    for k in range(bands.shape[1]):
        if k < band or ((hot >> k) & 1).any():
            same = bands[:, k][:, None] == bands[:, k][None, :]
            if k >= band:
                same &= (((hot >> k) & 1) == 1)[:, None]
            shared |= same
    link &= shared if band < 0 else ~shared
    documents, others = link @ copies, link.sum(axis=1)
    order = np.argsort(np.array(nodes, dtype="S16"), kind="stable")
    rank = np.empty(len(nodes), np.int32)
    rank[order] = np.arange(len(nodes))
    root = rank.copy()
    while True:  # smallest rank within reach
        new = np.minimum(root, np.where(link, root[None, :], np.int32(len(nodes))).min(axis=1))
        new = np.minimum(new, new[order[new]])
        if (new == root).all():
            break
        root = new
    return [(nodes[i], int(documents[i]), int(others[i]), nodes[order[root[i]]]) for i in np.flatnonzero(others)]


def tile_links(rows: DataFrame, docs: DataFrame, size: int, bands: int, per_band: int, threshold: float) -> DataFrame:
    """node, documents, nodes, root for each node and tile in which it has links.

    rows: rep, mark, copies, tile, band, side, hot. Tiles get texts, which are smaller than n-gram sets when shuffled, and
    make the sets of their nodes anew.
    """

    def compare(batches):
        s, held, tile = sketcher(size, bands, per_band), [], None

        def done():
            if len(held) < 2:
                return
            rows = {}  # repeated rows of one id come twice, other texts under a repeated id have another mark
            for own, (mark, copies, band, side, hot, _) in zip(s.sets([r[-1] for r in held]), held, strict=True):
                node = s.node(own)
                if node and s.mark(node) == mark:
                    rows[node] = (copies, band, side, hot, own)
            if len(rows) > 1:
                copies, band, sides, hot, sets = zip(*rows.values(), strict=True)
                yield from links_in_tile(list(rows), np.array(copies, np.float64), np.array(sides), band[0], s.band_hashes(list(sets)), np.array(hot, np.int64), list(sets), threshold)

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["node", "documents", "nodes", "root"])

        found: list = []
        for batch in batches:
            for t, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != tile:
                    found.extend(done())
                    held, tile = [], t
                held.append(rest)
            if len(found) > 5000:
                yield batch_of(found)
                found = []
        found.extend(done())
        if found:
            yield batch_of(found)
        held = found = []
        give_back()

    texts = docs.where(F.col("key").isNotNull()).select(F.col("key").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    met = rows.join(texts, "rep").select("tile", "mark", "copies", "band", "side", "hot", "text")
    return met.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "node binary, documents long, nodes long, root binary")


def components(edges: DataFrame, spark: SparkSession) -> tuple[DataFrame, str]:
    """node, root (the smallest node of its component) for edges node-root, and the folder that holds them.

    Labels move along edges by the minimum, and a label's own label replaces it; every round is written to the shared
    folder, which cuts the lineage, and joins and aggregates rows of two keys each. Rounds grow with the logarithm of a
    component's width. What a round has replaced is deleted.
    """
    edges, edges_at = written(edges.where("node <> root").distinct(), "edges")
    labels = edges.select("node", "root").unionByName(edges.select(F.col("root").alias("node"), "root")).groupBy("node").agg(F.min("root").alias("root"))
    old: list[str] = []
    while True:
        labels, labels_at = written(labels, "labels")
        removed(spark, *old)
        at = labels.select(F.col("node").alias("node"), F.col("root").alias("a"))
        to = labels.select(F.col("node").alias("root"), F.col("root").alias("b"))
        low = edges.join(at, "node").join(to, "root").where("a <> b").select("a", "b", F.least("a", "b").alias("low"))
        hooked, hooked_at = written(low.select(F.greatest("a", "b").alias("node"), "low").groupBy("node").agg(F.min("low").alias("low")), "hooked")
        if hooked.isEmpty():
            removed(spark, edges_at, hooked_at)
            return labels, labels_at
        # roots hooked to roots make chains: follow them to their ends before the labels are moved
        while True:
            jump = hooked.join(hooked.select(F.col("node").alias("low"), F.col("low").alias("lower")), "low", "left")
            jumped, jumped_at = written(jump.select("node", F.coalesce("lower", "low").alias("low"), F.col("lower").isNotNull().alias("moved")), "jumped")
            removed(spark, hooked_at)
            hooked, hooked_at = jumped.select("node", "low"), jumped_at
            if jumped.where("moved").isEmpty():
                break
        labels = labels.join(hooked.select(F.col("node").alias("root"), "low"), "root", "left").select("node", F.coalesce("low", "root").alias("root"))
        old = [labels_at, hooked_at]


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, with_node: bool = False) -> DataFrame:
    """key, class_id (the smallest id of its class), n_links (other documents at the threshold or above), n_link_texts (other n-gram sets among them); with_node adds node."""
    spark, docs = docs.sparkSession, pick(docs, key=key, text=text)
    bands, rows = bands_for(threshold, recall)
    signed, _ = written(signatures(docs, size, bands, rows), "signatures")
    able = signed.where(F.col("node").isNotNull() & F.col("key").isNotNull())
    nodes = able.groupBy("node").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("mark").alias("mark"), F.min("chars").alias("chars"), F.first("bands").alias("bands"))
    placed, kept = buckets_of(nodes, block, block_bytes)
    kept, kept_at = written(kept, "buckets")
    small, large = tiles_of(placed, kept)
    if kept.where("parts > 1").isEmpty():
        tiles = small.withColumn("hot", F.lit(0).cast("long"))
    else:
        bits = placed.join(kept.where("parts > 1").select("bucket"), "bucket").groupBy("rep", "mark").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("hot"))
        tiles = small.unionByName(large).join(bits, ["rep", "mark"], "left").withColumn("hot", F.coalesce("hot", F.lit(0).cast("long")))
    links, links_at = written(tile_links(tiles, docs, size, bands, rows, threshold), "links")
    counts = links.groupBy("node").agg(F.sum("documents").alias("documents"), F.sum("nodes").alias("nodes"))
    found, found_at = components(links.select("node", "root"), spark)
    known = nodes.select("node", "rep", "copies").join(found, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.where("nodes is not null").groupBy("root").agg(F.min("rep").alias("class_id"))
    known = known.join(least, "root", "left").select("node", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("nodes", F.lit(0)).alias("n_link_texts"))
    known, _ = written(known, "nodes")
    removed(spark, kept_at, links_at, found_at)
    out = signed.select("key", F.when(F.col("key").isNotNull(), F.col("node")).alias("node")).join(known, "node", "left")
    out = out.select("key", *(["node"] if with_node else []), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_link_texts", F.lit(0)).cast("long").alias("n_link_texts"))
    return out.withColumnRenamed("key", key)


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999, **how) -> DataFrame:
    """The documents, all columns, but of each class only the one of smallest id.

    Rows under one id are told apart by their n-gram sets: of those of a class that share its smallest id, one stays.
    Columns are taken by place; their names are put back at the end.
    """
    names, at, of = docs.columns, f"c{place_of(docs, key)}", f"c{place_of(docs, text)}"
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))
    classes = jaccard_classes(docs, at, of, size, threshold, recall, with_node=True, **how)
    decided, _ = written(classes.where(F.col(at).isNotNull() & F.col("node").isNotNull()).select(F.col(at).alias("id"), "node", (F.col("class_id") != F.col(at)).alias("out")), "classes")
    repeated = decided.groupBy("id").count().where("count > 1").select("id")
    gone = decided.where("out").select("id")
    if repeated.isEmpty():
        return docs.join(gone.hint("merge"), F.col(at) == F.col("id"), "left_anti").toDF(*names)  # as large as the input may make it: never broadcast
    bands, rows = bands_for(threshold, recall)
    single = docs.join(gone.unionByName(repeated).hint("merge"), F.col(at) == F.col("id"), "left_anti")

    def nodes(texts):
        s = sketcher(size, bands, rows)
        return [[s.node(x) for x in s.sets(texts)]]

    several = map_texts(docs.join(repeated, F.col(at) == F.col("id"), "left_semi"), of, docs.columns, [T.StructField("node", T.BinaryType())], nodes)
    out = decided.where("out").select(F.col("id").alias(at), "node").distinct()
    wordless = several.where("node is null")
    kept = several.where("node is not null").join(out, [at, "node"], "left_anti").dropDuplicates([at, "node"])
    return single.unionByName(kept.unionByName(wordless).select(docs.columns)).toDF(*names)
