"""TF-IDF in long form, cosine and descriptive words of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the weighting takes as a term: tokens are cut again at other signs.
TERM = r"([\p{L}\p{N}_][\p{L}\p{N}_.,-]*[\p{L}\p{N}_]|[\p{L}\p{N}_])"


def terms_of(tokens: Column) -> Column:
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit(TERM), F.lit(1))


def term_counts(docs: DataFrame, key: str, terms: str, scope: list[str] = ()) -> DataFrame:
    """scope, key, term, tf."""
    return docs.select(*scope, key, F.explode(terms).alias("term")).groupBy(*scope, key, "term").agg(F.count("*").cast("double").alias("tf"))


def weights(docs: DataFrame, key: str, terms: str, scope: list[str] = ()) -> DataFrame:
    """key, term, w: tf * (ln((1 + n) / (1 + df)) + 1), of unit length in each document.

    The corpus is all documents, or those of equal `scope` columns. Document frequencies and norms are aggregates that
    combine before their shuffle; counts and norms share the partitioning of the documents' keys.
    """
    counts = term_counts(docs, key, terms, scope)
    frequency = counts.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    n = docs.groupBy(*scope).agg(F.count("*").alias("n"))
    n = n.select(*scope, "n")
    joined = counts.join(frequency, [*scope, "term"])
    joined = joined.join(F.broadcast(n), list(scope)) if scope else joined.crossJoin(F.broadcast(n))  # one row
    raw = joined.select(*scope, key, "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    norms = raw.groupBy(*scope, key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, [*scope, key]).select(*scope, key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, ids: tuple[str, str] = ("id1", "id2")) -> DataFrame:
    """pairs with cos = 2 * cosine - 1 of their sides' weights (key, term, w); -1 without a common term."""
    a = left.select(F.col(left.columns[0]).alias(ids[0]), "term", F.col("w").alias("wa"))
    b = right.select(F.col(right.columns[0]).alias(ids[1]), "term", F.col("w").alias("wb"))
    dots = pairs.select(*ids).distinct().join(a, ids[0]).join(b, [ids[1], "term"]).groupBy(*ids).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return pairs.join(dots, list(ids), "left").withColumn("cos", 2 * F.coalesce("dot", F.lit(0.0)) - 1).drop("dot")


def top_terms(weights: DataFrame, key: str, k: int = 50) -> DataFrame:
    """key, top: the k terms of largest weight of each document, ties by term."""
    order = Window.partitionBy(key).orderBy(F.desc("w"), "term")
    return weights.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy(key).agg(F.sort_array(F.collect_list("term")).alias("top"))


def descriptive_overlap(a: Column, b: Column, k: int = 50) -> Column:
    return 2 * F.size(F.array_intersect(a, b)) / F.lit(float(k)) - 1
