"""The matching dataflow: normalise, pair, score, aggregate and export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.config import Config
from pairloom.functions import cleansing, python_udfs
from pairloom.functions.vocab import Vocabulary
from pairloom.ml import classifiers
from pairloom.operators import blocking, evaluation, features, relational
from pairloom.schema import PRODUCT, feature_columns
from pairloom.sources import writers


def normalise(rows: DataFrame, mapping: dict[str, str | list[str]], html_columns: tuple[str, ...] = ("short_description", "long_description"), prices: tuple[str, ...] = ("price",)) -> DataFrame:
    """Scraped rows under the product's column names: repeated rows gone, nested prices, specifications, images and codes
    flattened, markup turned into text, prices parsed."""
    out = cleansing.map_attributes(rows, mapping)
    kinds = dict(out.dtypes)
    for c, kind in kinds.items():
        col = F.col(f"`{c}`")
        if c in prices and kind.startswith("struct") and "formattedPrice" in kind:
            col = python_udfs.price_of_text(cleansing.formatted_price(col))
        elif c in prices and kind == "string":
            col = python_udfs.price_of_text(col)
        elif c == "specification" and kind.startswith("map"):
            col = cleansing.specification_of_map(col)
        elif c == "specification" and "label" in kind:
            col = cleansing.specification_of_labels(col)
        elif kind.startswith("array<struct<src"):
            col = cleansing.image_sources(col)
        elif c == "code" and kind == "array<array<string>>":
            col = cleansing.flat_codes(col)
        elif c == "code" and kind == "string":
            col = F.array(col)
        elif c in html_columns and kind == "string":
            col = python_udfs.html_text(col)
        else:
            continue
        out = out.withColumn(c, col)
    return out.dropDuplicates()


def as_products(df: DataFrame) -> DataFrame:
    """All columns of a product, null where they are missing."""
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in PRODUCT.fields))


def pair_with_source(targets: DataFrame, sources: DataFrame, on: str, ordinal: Column) -> tuple[DataFrame, DataFrame]:
    """Struct pairs of targets and their source, and targets without one."""
    found, lost = relational.lookup_join(targets.withColumn("__t", F.struct(*targets.columns)).select(on, "__t"), sources.withColumn("__s", F.struct(*sources.columns)).withColumn("__o", ordinal).select(on, "__s", "__o"), on, F.col("__o"))
    return found.select(F.col("__s").alias("p1"), F.col("__t").alias("p2")), lost.select("__t.*")


def match(pairs: DataFrame | None, left: DataFrame, right: DataFrame, model: classifiers.Model, vocabulary: Vocabulary, cache: DataFrame | None = None, config: Config = Config(), equal: list[tuple[str, str]] = (), **how) -> DataFrame:
    """id1, id2, all_texts_hash1, all_texts_hash2, predicted_scores, birthdate and predicted_match of candidate pairs.

    pairs: id1, id2 that are given, or None to find them by price and shared words. Pairs whose contents a cache has
    scored before keep that score. how: see features.tokenised.
    """
    a, b = features.tokenised(left, vocabulary, config, **how), features.tokenised(right, vocabulary, config, **how)
    if pairs is None:
        side = lambda t, i: t.select(F.col("id").alias(f"id{i}"), F.col("price").alias(f"price{i}"), F.col("name_plain").alias(f"name{i}"), *(F.col(c[i - 1][:-1]).alias(c[i - 1]) for c in equal))
        pairs = blocking.candidate_pairs(side(a, 1), side(b, 2), config, equal).select("id1", "id2")
    else:
        frame = features.pair_frame(pairs.select("id1", "id2"), a, b)
        pairs = frame.where(blocking.price_allows(F.col("price1"), F.col("price2"), config) & blocking.names_allow(F.col("name1"), F.col("name2"), config)).select("id1", "id2")
    known = None
    if cache is not None:
        hashes = lambda t, i: t.select(F.col("id").alias(f"id{i}"), F.col("all_texts_hash").alias(f"all_texts_hash{i}"))
        hashed = pairs.join(hashes(a, 1), "id1").join(hashes(b, 2), "id2")
        known, pairs = relational.split_by_cache(hashed, cache, ["all_texts_hash1", "all_texts_hash2"])
        today = F.date_format(F.current_date(), "yyyy-MM-dd").alias("birthdate")
        known = known.select("id1", "id2", "all_texts_hash1", "all_texts_hash2", "predicted_scores", today)
    fresh = model.score(features.features(pairs, a, b, config)).select("id1", "id2", "all_texts_hash1", "all_texts_hash2", F.col("score").alias("predicted_scores"), "birthdate")
    scored = fresh if known is None else fresh.unionByName(known)
    return scored.withColumn("predicted_match", F.when(F.col("predicted_scores") >= model.threshold, 1).otherwise(0))


def train_matcher(labelled: DataFrame, left: DataFrame, right: DataFrame, vocabulary: Vocabulary, kinds: list[str], config: Config = Config(), runs: int = 1, criterion: str = "max_precision", **how) -> classifiers.Trained:
    """The best model of several kinds and runs over labelled pairs (id1, id2, match). Each run has its own split and seed; how: see features.tokenised."""
    a, b = features.tokenised(left, vocabulary, config, **how), features.tokenised(right, vocabulary, config, **how)
    made = features.features(labelled, a, b, config).join(labelled.select("id1", "id2", "match"), ["id1", "id2"]).withColumn("pair_id", F.concat_ws("|", "id1", "id2"))
    made = writers.materialise(made, "labelled")
    found = [t for kind in kinds for run in range(runs) for t in classifiers.train(made, kind, feature_columns(config), config=config, criterion=criterion, run=run)]
    writers.discard(made)
    return classifiers.best_of(found)


def evaluate_matches(predicted: DataFrame, labels: DataFrame, removed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics of predictions against labels (removed ones left out), and the missed matches."""
    if removed is not None:
        labels = relational.anti_join_null_safe(labels, removed, ["id1", "id2"])
    both = relational.outer_labels(predicted.select("id1", "id2", "predicted_match"), labels.select("id1", "id2", "match"), ["id1", "id2"], ["predicted_match", "match"])
    return evaluation.metrics(both), both.where("match = 1 and predicted_match = 0")


def aggregate_matches(matches: DataFrame, source: DataFrame, competitor: DataFrame, company: str, name: str) -> DataFrame:
    """Price facts of matched pairs (url1, url2, id1, id2, name1, name2, brand) joined with both shops' rows."""
    s = source.select(F.col("url").alias("url1"), F.col("SKU").alias("CSKUID"))
    discounts = [c for c in cleansing.DISCOUNTS if c in competitor.columns]
    c = competitor.select(F.col("url").alias("url2"), cleansing.sku_of(F.col("SKU"), F.col("url")).alias("SKUID"), "netPrice", "originalPrice", *discounts)
    rows = matches.join(s, "url1").join(c, "url2").where(cleansing.same_model(F.col("name1"), F.col("name2"), F.col("id1"), F.col("id2"), F.col("brand"))).dropDuplicates(["url1", "url2"])
    original = cleansing.original_price(F.col("originalPrice"), F.col("netPrice"))
    kinds = dict(competitor.dtypes)
    values = {d: cleansing.discount_value(F.col(d), kinds[d]) for d in discounts}
    return rows.select(
        "SKUID", "CSKUID", F.col("name2").alias("name"), "brand", "netPrice", original.alias("originalPrice"), cleansing.discount_amount(F.col("netPrice"), original).alias("discountAmount"), F.col("url2").alias("skuUrl"),
        cleansing.discount_list(values, True).alias("discountType"), cleansing.discount_list(values, False).alias("discountName"),
        F.lit(company).alias("COMPID"), F.date_format(F.current_date(), "yyyy_MM_dd").alias("date"), F.lit(name).alias("competitor"),
    )


def export(frames: list[DataFrame], path: str, most_bytes: int = 100_000_000, send: Callable[[str], None] | None = None) -> None:
    """All frames together as bounded files, then handed over."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    writers.export_csv(every, path, most_bytes)
    if send:
        send(path)


def labelled_pairs(urls: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of labelled addresses with both products' columns, suffixed 1 and 2, and match."""
    a = left.select(*(F.col(c).alias(f"{c}1") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"{c}2") for c in right.columns))
    joined = urls.join(a, F.col("source_url") == F.col("url1")).join(b, F.col("target_url") == F.col("url2"))
    return joined.withColumn("match", cleansing.mapped_label(F.col("match_type"))).drop("source_url", "target_url", "match_type")


def publish_split(labelled: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Labelled pairs for learning (four fifths), for testing (a tenth), and the rest as two product tables."""
    learn, rest = relational.hash_split(labelled, key, 0.8)
    test, unlabelled = relational.hash_split(rest, key, 0.5, seed=43)
    return learn, test, relational.side_of(unlabelled, 1), relational.side_of(unlabelled, 2)
