"""Joins, deduplication, sampling and chunks as the matching pipeline needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.sources.writers import materialise


def first_of_each(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """One row of each key: the first (or last) in the order, of equal ones the smallest (largest) row.

    An aggregate that combines before its shuffle, so a key of very many rows costs one row a task. Null keys are a key.
    """
    pick = F.max if last else F.min
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(order.alias("__order"), *(F.col(f"`{c}`") for c in rest))).alias("__row"))
    return best.select(*(F.col(f"`{c}`") if c in keys else F.col("__row")[c].alias(c) for c in df.columns))


def lookup_join(targets: DataFrame, sources: DataFrame, on: str, ordinal: Column) -> tuple[DataFrame, DataFrame]:
    """Targets with their source (of repeated ones the last), and the targets that have none."""
    last = first_of_each(sources, [on], ordinal, last=True)
    return targets.join(last, on), targets.join(sources.select(on).distinct(), on, "left_anti")


def split_by_cache(pairs: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs whose keys the cache holds, with its scores, and the other pairs. Of repeated cache keys the largest score counts."""
    known = cache.groupBy(*keys).agg(F.max("predicted_scores").alias("predicted_scores"))
    return pairs.join(known, keys), pairs.join(known, keys, "left_anti")


def anti_join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left that right doesn't hold; nulls equal nulls."""
    r = right.select([F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on &= left[k].eqNullSafe(r[f"__{k}"])
    return left.join(r, on, "left_anti")


def outer_labels(predictions: DataFrame, labels: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Predictions and labels side by side, 0 where one side lacks a pair."""
    both = predictions.join(labels, keys, "full_outer")
    return both.select(*keys, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns))


def hash_split(df: DataFrame, key: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A repeatable split by the hash of a key."""
    at = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(at), df.where(~at)


def weighted_sample(df: DataFrame, weight: Column, share: float, seed: int = 42) -> DataFrame:
    """Sample with replacement: each row stands as often as a Poisson draw of weight * share says, from its own random number."""
    # the count of a Poisson draw: how many partial sums of the distribution a uniform number has passed
    steps = F.sequence(F.lit(1), F.lit(23))
    first = F.struct(F.exp(-F.col("__rate")).alias("term"), F.exp(-F.col("__rate")).alias("sum"), (F.col("__u") >= F.exp(-F.col("__rate"))).cast("int").alias("times"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * F.col("__rate") / k
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"), (state["times"] + (F.col("__u") >= state["sum"] + term).cast("int")).alias("times"))

    drawn = df.withColumn("__rate", (weight * share).cast("double")).withColumn("__u", F.rand(seed)).withColumn("__times", F.aggregate(steps, first, add, lambda s: s["times"]))
    return drawn.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__rate", "__u", "__times", "__copy")


def numbered(df: DataFrame, order: str, number: str = "__number") -> DataFrame:
    """Rows numbered from 0 in the order of a unique column, without a single task that sorts all rows.

    Rows are dealt by range and written once; each range's size is added up (a row a range), and rows are numbered in
    their range.
    """
    ranged = materialise(df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    placed = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    return placed.join(F.broadcast(before), "__part").withColumn(number, F.col("__before") + F.col("__in") - 1).drop("__part", "__in", "__before")


def chunk_ids(df: DataFrame, order: str, size: int = 500) -> DataFrame:
    """The number of each row's chunk of so many rows, in the order of a unique column."""
    return numbered(df, order).withColumn("chunk", F.floor(F.col("__number") / size).cast("int")).drop("__number")


def query_chunks(df: DataFrame, order: str, parts: int) -> DataFrame:
    """Rows dealt in the order of a unique column to so many chunks (from 1), as even as can be, the first ones larger."""
    n = df.count()
    each, more = divmod(n, parts)
    at = F.col("__number")
    chunk = F.when(at < more * (each + 1), at / (each + 1)).otherwise(more + (at - more * (each + 1)) / max(each, 1))
    return numbered(df, order).withColumn("chunk", (F.floor(chunk) + 1).cast("int")).drop("__number")


def side_of(pairs: DataFrame, side: int, also: tuple[str, ...] = ()) -> DataFrame:
    """The columns of one side of pairs, whose names end in 1 or 2, without that ending; also: columns to keep as they are."""
    return pairs.select(*(F.col(f"`{c}`").alias(c[:-1]) for c in pairs.columns if c.endswith(str(side))), *also)
