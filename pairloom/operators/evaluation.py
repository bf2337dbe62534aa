"""Counts and metrics of predictions, thresholds and feature statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.config import Config


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(label: str, predicted: str) -> list[Column]:
    y, p = F.col(label), F.col(predicted)
    count = lambda c: F.count_if(c)
    return [count((y == 1) & (p == 1)).alias("tp"), count((y == 0) & (p == 1)).alias("fp"), count((y == 0) & (p == 0)).alias("tn"), count((y == 1) & (p == 0)).alias("fn")]


def with_metrics(counts: DataFrame) -> DataFrame:
    """accuracy, recall, specificity, precision and f1 of tp, fp, tn, fn; 0 where nothing is divided by."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def metrics(df: DataFrame, label: str = "match", predicted: str = "predicted_match") -> DataFrame:
    return with_metrics(df.agg(*confusion(label, predicted)))


def confusion_matrix(df: DataFrame, label: str = "match", predicted: str = "predicted_match") -> DataFrame:
    return df.groupBy(label).pivot(predicted, [0, 1]).count().na.fill(0)


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count()


def thresholds(df: DataFrame, score: str, k: int = 100) -> DataFrame:
    """threshold: the last score of each of k even buckets but the last one.

    Scores are counted first; ranks come from the distinct scores' running counts, so repeated scores are not sorted.
    """
    counted = df.groupBy(score).agg(F.count("*").alias("held")).withColumn("__part", F.least(F.greatest(F.floor(F.coalesce(F.col(score), F.lit(0.0)) * 4096), F.lit(-1)), F.lit(4096)))
    sums = counted.groupBy("__part").agg(F.sum("held").alias("of"))  # 4098 rows at most
    before = sums.select("__part", (F.sum("of").over(Window.orderBy("__part")) - F.col("of")).alias("before"), F.sum("of").over(Window.partitionBy()).alias("n"))
    upto = counted.join(F.broadcast(before), "__part").withColumn("upto", F.col("before") + F.sum("held").over(Window.partitionBy("__part").orderBy(score)))
    # bucket i (from 1) ends at i * (n div k) + least(i, n mod k)
    ends = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.struct(i.alias("bucket"), (i * F.floor(F.col("n") / k) + F.least(i, F.col("n") % k)).alias("end")))
    met = upto.withColumn("b", F.explode(F.filter(ends, lambda e: (e["end"] <= F.col("upto")) & (e["end"] > F.col("upto") - F.col("held")))))
    return met.where("n >= " + str(k)).select(F.col("b.bucket").alias("bucket"), F.col(score).alias("threshold"))


def sweep(df: DataFrame, limits: DataFrame, label: str = "match", score: str = "score") -> DataFrame:
    """Metrics and hard-label AUC at every threshold; limits has at most a few hundred rows.

    Each row is counted once, by the number of thresholds that its score reaches; the counts of all thresholds are sums
    over those few groups.
    """
    limits = limits.select("threshold").where("threshold is not null").distinct()
    every = limits.agg(F.sort_array(F.collect_list("threshold")).alias("limits"))  # a bounded list
    met = df.select(F.col(label).alias("y"), F.col(score).alias("s")).where("s is not null").crossJoin(F.broadcast(every))
    held = met.groupBy(F.size(F.filter("limits", lambda t: t <= F.col("s"))).alias("reached")).agg(F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") == 0).alias("zeros"))
    rank = limits.crossJoin(F.broadcast(every)).select("threshold", F.array_position("limits", F.col("threshold")).alias("rank"))
    over = F.col("reached") >= F.col("rank")
    total = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0))
    at = rank.crossJoin(F.broadcast(held)).groupBy("threshold").agg(total("ones", over).alias("tp"), total("zeros", over).alias("fp"), total("zeros", ~over).alias("tn"), total("ones", ~over).alias("fn"))
    return with_metrics(at).withColumn("auc", (F.col("recall") + F.col("specificity")) / 2)


def mean_statistics(runs: list[dict]) -> dict:
    """The mean of each number over the statistics of several runs."""
    return {k: sum(r[k] for r in runs) / len(runs) for k in runs[0] if isinstance(runs[0][k], int | float)} if runs else {}


def best_threshold(rows: list, criterion: str = "max_precision", config: Config = Config()) -> dict | None:
    """The best of a sweep's rows by ascending threshold: the first of the best primary value, then of the better secondary one."""
    best = None
    for r in sorted((x.asDict() if hasattr(x, "asDict") else x for x in rows), key=lambda x: x["threshold"]):
        if criterion == "max_f1":
            able, value = True, (r["f1"], 0.0)
        elif criterion == "max_precision":
            able, value = r["recall"] > config.least_recall, (r["precision"], r["recall"])
        elif criterion == "max_recall":
            able, value = r["precision"] > config.least_precision, (r["recall"], r["precision"])
        elif criterion == "balanced_precision_recall":
            able, value = True, (-abs(r["precision"] - r["recall"]), r["f1"])
        else:
            raise ValueError(f"no such criterion: {criterion}")
        if able and (best is None or value > best[0]):
            best = (value, r)
    return best[1] if best else None


def roc_points(rates: DataFrame) -> DataFrame:
    """False and true positive rates of a sweep, with both ends."""
    points = rates.select((1 - F.col("specificity")).alias("fpr"), F.col("recall").alias("tpr"))
    ends = rates.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, tpr double")
    return points.unionByName(ends)


def nonzero_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of rows in which each column isn't 0."""
    return df.agg(*(F.avg((F.col(c) != 0).cast("double") * 100).alias(c) for c in columns))


def correlations(df: DataFrame, columns: list[str], least: float | None = None) -> DataFrame:
    """a, b, r of every two columns, in one pass; least: only |r| above it."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs)).alias("all"))
    out = row.select(F.explode("all").alias("p")).select("p.a", "p.b", "p.r")
    return out.where(F.abs("r") > least) if least is not None else out


def misclassified_often(frames: list[DataFrame], key: str, times: int | None = None) -> DataFrame:
    """How many of several lists of misclassified rows hold each row; times: only rows that so many hold."""
    every = frames[0].select(key)
    for f in frames[1:]:
        every = every.unionByName(f.select(key))
    counts = every.groupBy(key).agg(F.count("*").alias("times"))
    return counts.where(F.col("times") == times) if times is not None else counts


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, n: lower-cased words of letters only; by_count(...) puts the most frequent first."""
    return docs.select(F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("word")).where(F.col("word").rlike(r"^\p{L}+$")).groupBy("word").agg(F.count("*").alias("n"))


def by_count(counts: DataFrame, key: str = "word", n: str = "n") -> DataFrame:
    """Rows by descending count, equal ones by key."""
    return counts.orderBy(F.desc(n), key)
