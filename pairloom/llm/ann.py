"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Each of `projections` random directions has a sorted array of the unit vectors' projections. A query counts, for every
vector, in how many arrays it lies within w of the query's own projection; vectors counted `threshold` times are verified
by their exact cosine. Windows grow by a factor each round (virtual rehashing), and only their new parts are read.

The rounds end by what the counts prove, not by a cap: a vector at distance s is counted once with a chance that follows
from w / s, so at each w there is a distance R(w) within which a vector reaches the threshold with chance `recall` at
least. A query stops once its k-th nearest found is within R(w), or all vectors are verified, as they are once windows
span all projections.

Every task indexes the vectors that it reads, in shards of bounded size; queries come in blocks of bounded size, each of
which is a pass over the vectors; each task sends on the k nearest it found of each query.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; a
query meets the vectors of its own length, since others have no cosine with it; a query's own id is no candidate; equal vectors tie, smaller ids first;
repeated candidate rows count each, of repeated query ids the smallest vector asks; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import give_back, place_of

QUERY_BLOCK, SHARD = 3000, 32_768


@functools.lru_cache(maxsize=8)
def window_ratio(projections: int, threshold: int, recall: float) -> float:
    """The least w / s at which a vector at distance s is counted `threshold` times with chance `recall`."""

    def reaches(p: float) -> float:
        return sum(comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(threshold, projections + 1))

    lo, hi = 0.0, 8.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if reaches(erf(mid / sqrt(2))) >= recall else (mid, hi)
    return hi


@functools.lru_cache(maxsize=64)
def directions_of(projections: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((projections, dims))


class Shard:
    """At most SHARD vectors of one length with their sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        self.ids, self.vectors, self.directions = ids, vectors, directions
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        placed = directions @ (vectors / self.norms[:, None]).T
        self.order = np.argsort(placed, axis=1, kind="stable").astype(np.int32)
        self.placed = np.take_along_axis(placed, self.order, axis=1)
        # where each vector stands in each array: what a window of half the array holds is counted faster by it
        self.ranks = np.empty(placed.shape, np.uint16)
        np.put_along_axis(self.ranks, self.order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)

    def counts(self, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
        """In how many arrays each vector stands from a to b."""
        m, n = self.ranks.shape
        if int((b - a).sum()) * 16 < m * n:
            return np.bincount(np.concatenate([self.order[j, a[j] : b[j]] for j in range(m)]), minlength=n)
        low, wide = a.astype(np.uint16)[:, None], (b - a).astype(np.uint16)[:, None]
        parts = [np.add.reduce((self.ranks[:, c : c + step] - low < wide).view(np.uint8), axis=0, dtype=np.uint8 if m < 256 else np.int32) for c in range(0, n, step)]
        return np.concatenate(parts)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: int, ratio: float, first: float, factor: float) -> list[tuple[int, int, float]]:
        """(query id, vector id, cosine) of the k nearest found of each query."""
        norms, out = np.sqrt((queries * queries).sum(axis=1)), []
        centre = self.directions @ (queries / norms[:, None]).T
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        for q in range(len(queries)):
            open_ = self.ids != query_ids[q]
            scores, found = np.empty(0), np.empty(0, np.int64)
            t = 0
            while open_.any():
                w = first * factor**t
                if len(rounds) == t:  # borders of all queries' windows at once
                    rounds.append(tuple(np.stack([np.searchsorted(p, c + s, side) for p, c in zip(self.placed, centre, strict=True)]) for s, side in ((-w, "left"), (w, "right"))))
                new = np.flatnonzero(open_ & (self.counts(rounds[t][0][:, q], rounds[t][1][:, q]) >= threshold))
                t += 1
                if len(new):
                    open_[new] = False
                    if len(new) > 64:  # what a rough product puts clearly behind the k-th needs no exact score
                        rough = (self.vectors @ queries[q])[new] / self.norms[new] if 4 * len(new) > len(open_) else self.vectors[new] @ queries[q] / self.norms[new]
                        least = max(scores[-1] * norms[q] if len(found) == k else -np.inf, np.partition(rough, -k)[-k] if k <= len(rough) else -np.inf)
                        new = new[rough >= least - 1e-9 * norms[q]]
                    score = (self.vectors[new] * queries[q]).sum(axis=1) / (self.norms[new] * norms[q])
                    scores, found = np.concatenate([scores, score]), np.concatenate([found, new])
                    best = np.lexsort((self.ids[found], -scores))[:k]
                    scores, found = scores[best], found[best]
                if len(found) == k and 2 - 2 * scores[-1] <= (w / ratio) ** 2:
                    break
            out += [(int(query_ids[q]), int(self.ids[i]), float(s)) for i, s in zip(found, scores, strict=True)]
        return out


def usable(batch_ids: pa.Array, lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and vectors, in double precision, of the rows that take part.

    Each vector is scaled by the power of two that brings its largest component near 1: cosines stay the same to the last
    bit, and squares neither vanish nor overflow.
    """
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    sizes = np.where(batch_ids.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    for dims in np.unique(sizes[sizes > 0]).tolist():
        keep = pa.array(sizes == dims)
        ids = batch_ids.filter(keep).to_numpy()
        x = lists.filter(keep).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dims)
        largest = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (largest > 0)
        yield dims, ids[good], np.ldexp(x[good], -np.frexp(largest[good])[1][:, None])


def nearest(vectors: DataFrame, asks: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", projections: int = 96, threshold: int = 40, recall: float = 0.97, first: float = 0.4, factor: float = 1.3, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine of each row for which `asks` holds."""
    marked = vectors.select("*", asks.alias("asks")).toDF(*(f"c{i}" for i in range(len(vectors.columns))), "asks")
    able = marked.select(F.col(f"c{place_of(vectors, key)}").cast("long").alias("vec_id"), F.col(f"c{place_of(vectors, vector)}").cast("array<double>").alias("v"), "asks").where("vec_id is not null and v is not null")
    whole = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    wanted = able.where("asks").where(whole).groupBy("vec_id").agg(F.min("v").alias("v"))
    able, n, ratio = able.select("vec_id", "v"), wanted.count(), window_ratio(projections, threshold, recall)
    passes, found = max(1, -(-n // QUERY_BLOCK)), None
    for p in range(passes):
        block = wanted.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).orderBy("vec_id").toArrow()
        by_length = {dims: (ids, x) for dims, ids, x in usable(block.column(0).combine_chunks(), block.column(1).combine_chunks())} if block.num_rows else {}
        asked = vectors.sparkSession.sparkContext.broadcast(by_length)

        def search(batches, asked=asked):
            held: dict[int, list] = {}  # by length: ids and vectors not yet searched
            best: dict[int, list] = {}

            def add(dims):
                ids, x = zip(*held.pop(dims), strict=True)
                for q, i, s in Shard(np.concatenate(ids), np.concatenate(x), directions_of(projections, dims, seed)).search(*asked.value[dims], k, threshold, ratio, first, factor):
                    best.setdefault(q, []).append((-s, i))
                for q, rows in best.items():
                    best[q] = sorted(rows)[:k]

            for batch in batches:
                for dims, ids, x in usable(batch.column(0), batch.column(1)):
                    if dims not in asked.value:
                        continue
                    for a in range(0, len(ids), SHARD):
                        own = ids[a : a + SHARD]
                        if dims in held and sum(len(i) for i, _ in held[dims]) + len(own) > SHARD:
                            add(dims)
                        held.setdefault(dims, []).append((own, x[a : a + SHARD]))
            for dims in list(held):
                add(dims)
            rows = [(q, i, -s) for q, own in best.items() for s, i in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])
            give_back()

        made = able.mapInArrow(search, "query_id long, vec_id long, score double")
        found = made if found is None else found.unionByName(made)
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
