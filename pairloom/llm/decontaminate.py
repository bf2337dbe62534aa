"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity.

An item of n words is compared with windows of n words. Item and windows have SimHash fingerprints over their weighted
shingles (weight: how often a shingle stands there). Fingerprints are cut into blocks; two that differ in at most
`radius` bits differ in at most radius // blocks bits of some block, so tables of all block values that near an item's
own find every such pair. Pairs within the radius are verified by weighted Jaccard: sum of the smaller weights over sum
of the larger. A window that holds none of an item's shingles has similarity 0 and is not fingerprinted.

Windows of a text shorter than an item are the whole text. Items of fewer words than a shingle are compared on shingles
of their own size. Items are a query set, taken in blocks of bounded size, each against all documents.

Defined results: of windows alike in similarity the first is reported; items without a word match nothing; null and empty texts match nothing; repeated rows and items are
reported each; an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import map_texts, pick, place_of
from pairloom.llm.shingles import SHINGLE, shingle_hashes, word_hashes

#: Items that a table of block values answers for, and such tables in one pass over the documents.
TABLE_ITEMS, TABLES = 256, 16
BLOCKS, BLOCK_BITS = 4, 16
BITS = np.arange(64, dtype=np.uint64)
#: Shingles of a text that are fingerprinted at once, about.
STRETCH = 32_768


def prefix_bits(shingles: np.ndarray, bits: np.ndarray = BITS) -> np.ndarray:
    """Row i: how many of the first i shingles have each of these bits set."""
    out = np.zeros((len(shingles) + 1, len(bits)), np.int32)
    np.cumsum((shingles[:, None] >> bits) & np.uint64(1), axis=0, out=out[1:])
    return out


def fingerprints(shingles: np.ndarray, start: np.ndarray, end: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """SimHash of the shingles from each start to its end: a bit is set if more than half of them have it.

    start ascends. A long text is walked in stretches of windows, a stretch that is long itself a few bits at a time, so
    that memory stays below some 100 bytes a shingle of the longer of stretch and window.
    """
    out = np.zeros(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + stretch)))
        low, high = int(start[a]), int(end[a:b].max())
        own, lo, hi = shingles[low:high], start[a:b] - low, end[a:b] - low
        step = 64 if high - low <= 2 * stretch else 4
        for bit in range(0, 64, step):
            prefix = prefix_bits(own, BITS[bit : bit + step])
            more = 2 * (prefix[hi] - prefix[lo]) > (hi - lo)[:, None]
            out[a:b] |= (more.astype(np.uint64) << BITS[bit : bit + step]).sum(axis=1, dtype=np.uint64)
        a = b
    return out


@functools.lru_cache(maxsize=8)
def near_values(radius: int) -> np.ndarray:
    """All block values of at most `radius` set bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(BLOCK_BITS), r)], np.int64)


class Items:
    """At most TABLE_ITEMS items whose shingles have one size, ready to be looked up."""

    def __init__(self, ids: list, texts: list[str], shingle: int, radius: int, threshold: float):
        self.ids, self.shingle, self.radius, self.threshold = ids, shingle, radius, threshold
        flat, at = shingle_hashes(texts, shingle)
        self.shingles = [flat[a:b] for a, b in itertools.pairwise(at)]
        self.lengths = np.diff(at)
        self.weights = [Counter(s.tolist()) for s in self.shingles]
        self.marks = np.concatenate([fingerprints(s, np.array([0]), np.array([len(s)])) for s in self.shingles])
        order = np.argsort(flat, kind="stable")
        self.sorted, self.owner = flat[order], np.repeat(np.arange(len(ids)), self.lengths)[order]
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(flat >> np.uint64(44)).astype(np.int64)] = True
        # for each block and value: a bit for each item whose own value is near
        self.table = np.zeros((BLOCKS, 1 << BLOCK_BITS, TABLE_ITEMS // 64), np.uint64)
        for i, mark in enumerate(self.marks):
            for b in range(BLOCKS):
                value = int(mark >> np.uint64(b * BLOCK_BITS)) & 0xFFFF
                self.table[b, near_values(radius // BLOCKS) ^ value, i // 64] |= np.uint64(1 << (i % 64))

    def held(self, flat: np.ndarray) -> np.ndarray:
        """Which shingles are an item's."""
        out = np.flatnonzero(self.gate[(flat >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, flat[out]), len(self.sorted) - 1)
        return out[self.sorted[at] == flat[out]]

    def hits(self, own: np.ndarray, places: np.ndarray) -> list[tuple]:
        """The best window for each item that a text's shingles match; places: of those that some item holds."""
        lo, hi = np.searchsorted(self.sorted, own[places]), np.searchsorted(self.sorted, own[places], "right")
        rows = np.repeat(np.arange(len(places)), hi - lo)
        items = self.owner[np.arange(len(rows)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
        at, n, best = places[rows], len(own), {}
        for length in np.unique(self.lengths[items]).tolist():
            # all windows of this size that hold a shingle of an item of this size
            edge = np.zeros(n + 1, np.int64)
            mine = at[self.lengths[items] == length]
            np.add.at(edge, np.clip(mine - length + 1, 0, max(n - length, 0)), 1)
            np.add.at(edge, np.clip(mine, 0, max(n - length, 0)) + 1, -1)
            start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            end = np.minimum(start + length, n)
            marks = fingerprints(own, start, end)
            near = np.zeros((len(start), self.table.shape[2]), np.uint64)
            for b in range(BLOCKS):
                near |= self.table[b, ((marks >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)]
            for i in np.flatnonzero(self.lengths == length):
                w = np.flatnonzero(near[:, i // 64] >> np.uint64(i % 64) & np.uint64(1))
                distance = np.bitwise_count(marks[w] ^ self.marks[i]).astype(int)
                for k, d in zip(w[distance <= self.radius].tolist(), distance[distance <= self.radius].tolist(), strict=True):
                    window = Counter(own[start[k] : end[k]].tolist())
                    both = sum(min(c, window[s]) for s, c in self.weights[i].items() if s in window)
                    similarity = both / (length + int(end[k] - start[k]) - both)
                    if similarity >= self.threshold - 1e-12 and similarity > best.get(i, (0.0,))[0]:
                        best[i] = (similarity, int(start[k]), int(end[k] - start[k]) + self.shingle - 1, d)
        return [(self.ids[i], s, w, sim, d) for i, (sim, s, w, d) in sorted(best.items())]


@functools.lru_cache(maxsize=4)
def tables(rows: tuple[tuple[object, str], ...], radius: int, threshold: float) -> list[Items]:
    """Items by shingle size, in blocks; one copy for each worker process."""
    _, at = word_hashes([t for _, t in rows])
    by_size: dict[int, list] = {}
    for (i, text), n in zip(rows, np.diff(at).tolist(), strict=True):
        if n:
            by_size.setdefault(min(n, SHINGLE), []).append((i, text))
    return [Items(*map(list, zip(*part, strict=True)), size, radius, threshold) for size, own in sorted(by_size.items()) for part in itertools.batched(own, TABLE_ITEMS)]


def find_hits(texts: list[str], rows: tuple[tuple[object, str], ...], radius: int, threshold: float) -> list[list[tuple]]:
    out: list[list[tuple]] = [[] for _ in texts]
    made: dict[int, tuple] = {}
    for items in tables(rows, radius, threshold):
        if items.shingle not in made:
            made[items.shingle] = shingle_hashes(texts, items.shingle)
        flat, at = made[items.shingle]
        places = items.held(flat)
        for t in np.unique(np.searchsorted(at, places, "right") - 1).tolist():
            own = places[(places >= at[t]) & (places < at[t + 1])] - at[t]
            out[t] += items.hits(flat[at[t] : at[t + 1]], own)
    return out


def item_passes(benchmark: DataFrame, item: str, text: str) -> list[tuple[tuple[object, str], ...]]:
    """The items in groups of about 3/4 TABLE_ITEMS * TABLES; one group is on the driver and in the workers at a time."""
    rows = pick(benchmark, i=item, t=text).where(F.col("t").isNotNull()).distinct()
    n = rows.count()
    passes = -(-n // (TABLE_ITEMS * TABLES * 3 // 4))
    dealt = rows.withColumn("p", F.pmod(F.xxhash64("i", "t"), F.lit(max(passes, 1))))
    return [tuple(sorted(((r["i"], r["t"]) for r in dealt.where(F.col("p") == p).collect()), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))) for p in range(passes)]


def hit_type(item: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", item), T.StructField("start_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.IntegerType())]))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", radius: int = 19, threshold: float = 0.8) -> DataFrame:
    """key, item_id, start_word, n_words, similarity, distance: the best window of each document for each item it holds."""
    docs, hit = pick(docs, key=key, text=text), hit_type(benchmark.schema[place_of(benchmark, item)].dataType)
    found = docs.select("key", F.lit(None).cast(hit).alias("hits")).where("false")
    for n, rows in enumerate(item_passes(benchmark, item, "text")):
        made = map_texts(docs, "text", ["key"], [T.StructField("hits", hit)], lambda texts, rows=rows: [[[dict(zip(hit.elementType.names, h, strict=True)) for h in hits] for hits in find_hits(texts, rows, radius, threshold)]])
        found = found.unionByName(made) if n else made
    return found.select("key", F.explode("hits").alias("hit")).select(F.col("key").alias(key), "hit.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", radius: int = 19, threshold: float = 0.8) -> DataFrame:
    """The documents, all columns, in which no item is found."""
    for rows in item_passes(benchmark, item, "text"):
        docs = map_texts(docs, text, docs.columns, [], lambda texts, rows=rows: find_hits(texts, rows, radius, threshold), lambda hits: [not h for h in hits])
    return docs
