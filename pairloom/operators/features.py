"""The feature frame of pairs: one fixed schema, whatever the data holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.config import KEYWORD_LISTS, SIMILARITIES, Config
from pairloom.functions import keywords, similarity, text
from pairloom.functions.vocab import Vocabulary
from pairloom.operators import tfidf
from pairloom.schema import feature_columns
from pairloom.sources.writers import materialise

BASE = ("name", "short_description", "long_description")


def tokenised(products: DataFrame, vocabulary: Vocabulary, config: Config = Config(), decompose: bool = True, dictionary: Column | None = None, known_words: Column | None = None) -> DataFrame:
    """id, price, url, code, and tagged tokens of every text column, of the keyword lists and of the specification.

    One projection without a shuffle, written once since every feature reads it. products: as schema.PRODUCT.
    dictionary: a map column of lemmas, for config.language "czech"; known_words: an array of words that are no identifiers.
    """
    empty = F.array().cast("array<string>")
    if config.language == "czech" and dictionary is None:
        raise ValueError("lemmas need a dictionary")
    spec = text.last_of_each(F.coalesce("specification", F.array().cast("array<struct<key:string,value:string>>")))
    # functions in Python stand in a projection of their own: behind it their results are plain columns
    given = products.select("id", "price", "url", F.coalesce("code", F.array(F.lit(""))).alias("code"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in BASE), text.specification_text(spec).alias("specification_text"), F.transform(spec, lambda e: e["key"]).alias("keys"), F.transform(spec, lambda e: e["value"]).alias("values"))
    given = given.withColumns({c: text.clean_text(F.col(c), decompose) for c in (*BASE, "specification_text")} | {c: text.cleaned_each(F.col(c), decompose) for c in ("keys", "values")})
    words = lambda c: text.worded(text.cleaned_tokens(c, config.lower_case), config.language == "english", dictionary if config.language == "czech" else None)
    tokens = {c: words(F.col(c)) for c in (*BASE, "specification_text")}
    tags = lambda t, **on: keywords.tag_tokens(t, vocabulary, config, **on, known_words=known_words)
    entries = F.zip_with("keys", "values", lambda k, v: F.struct(F.array_join(text.cleaned_tokens(k), " ").alias("key"), F.array_join(tags(text.cleaned_tokens(v), colors=False, ids=False, brands=False), " ").alias("value")))
    plain = given.select("id", "price", "url", "code", *(c.alias(f"{n}_plain") for n, c in tokens.items()), entries.alias("specification"))
    marked = plain.withColumns({n: tags(F.col(f"{n}_plain"), **config.detected(n)) for n in tokens})
    lists = keywords.keyword_lists(*(F.col(n) for n in tokens))
    out = marked.withColumns({n: F.coalesce(c, empty) for n, c in lists.items()})
    out = out.withColumn("all_texts", text.all_texts(*(F.col(n) for n in tokens)))
    out = out.withColumn("all_texts_hash", text.content_hash(*(F.array_join(n, "") for n in tokens), keywords.python_float(F.col("price"))))
    return materialise(out, "tokens")


def specification_matches(pairs: DataFrame, config: Config = Config()) -> DataFrame:
    """id1, id2, specification_key_matches and specification_key_value_matches.

    Ratios of texts are computed once for each two distinct keys (and values) that meet.
    """
    sides = pairs.select("id1", "id2", "specification1", "specification2")
    met = sides.select("id1", "id2", F.posexplode("specification1").alias("i", "e1"), "specification2").select("id1", "id2", "i", "e1", F.posexplode("specification2").alias("j", "e2"))
    keys = met.select(F.col("e1.key").alias("k1"), F.col("e2.key").alias("k2")).distinct().withColumn("ratio", similarity.text_ratio(F.col("k1"), F.col("k2")))
    rated = met.join(keys, (F.col("e1.key") == F.col("k1")) & (F.col("e2.key") == F.col("k2")))
    nearest = rated.groupBy("id1", "id2", "i").agg(F.max(F.struct("ratio", (-F.col("j")).alias("first"), "e1", "e2")).alias("m")).where(F.col("m.ratio") >= config.key_ratio).select("id1", "id2", F.col("m.e1.value").alias("v1"), F.col("m.e2.value").alias("v2"))
    values = nearest.select("v1", "v2").distinct().withColumn("ratio", similarity.text_ratio(F.regexp_replace("v1", r" #unit#\w*", ""), F.regexp_replace("v2", r" #unit#\w*", "")))
    alike = similarity.values_alike(F.col("v1"), F.col("v2"), F.col("ratio"), config)
    hits = nearest.join(values, ["v1", "v2"]).groupBy("id1", "id2").agg(F.count("*").alias("keys"), F.count_if(alike).alias("both"))
    n = F.size("specification1")
    share = lambda c: F.when(n > 0, F.coalesce(F.col(c), F.lit(0)) / n).otherwise(0.0)
    return sides.join(hits, ["id1", "id2"], "left").select("id1", "id2", share("keys").alias("specification_key_matches"), share("both").alias("specification_key_value_matches"))


def pair_frame(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """id1, id2 and any other columns of pairs, with both sides' columns suffixed 1 and 2."""
    a = left.select(*(F.col(c).alias(f"{c}1") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"{c}2") for c in right.columns))
    return pairs.join(a, "id1").join(b, "id2")


def split_marked(tokens: DataFrame, columns: tuple[str, ...] = (*BASE, "specification_text")) -> tuple[DataFrame, DataFrame]:
    """Tokenised products with the marks of keywords in their text columns, and with the plain tokens in their place."""
    names = [f"{c}_plain" for c in columns]
    return tokens.drop(*names), tokens.drop(*columns).withColumnsRenamed(dict(zip(names, columns, strict=True)))


def image_similarities(pairs: DataFrame, images1: DataFrame, images2: DataFrame, config: Config = Config()) -> DataFrame:
    """id1, id2, hash_similarity of pairs, 0 where a side has no image. images: id, hash, a row an image."""
    of = lambda images, i: images.where("hash is not null").groupBy(F.col("id").alias(f"id{i}")).agg(F.sort_array(F.collect_list("hash")).alias(f"h{i}"))
    both = pairs.select("id1", "id2").distinct().join(of(images1, 1), "id1", "left").join(of(images2, 2), "id2", "left")
    return both.select("id1", "id2", F.coalesce(similarity.hash_similarity(F.col("h1"), F.col("h2"), config.image_limit), F.lit(0.0)).alias("hash_similarity"))


def features(pairs: DataFrame, left: DataFrame, right: DataFrame, config: Config = Config(), birthdate: Column | None = None, images: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Ids, hashes, birthdate and all model inputs of pairs (id1, id2, ...) over tokenised products.

    images: id, hash of both sides' images, for a column hash_similarity behind the others.
    """
    frame = pair_frame(pairs.select("id1", "id2").distinct(), left, right)
    made: dict[str, Column] = {}
    plain = {"id": similarity.id_ratio, "brand": similarity.brand_ratio, "words": similarity.words_ratio, "units": lambda a, b: similarity.units_distance(a, b, config), "numbers": similarity.numbers_distance}
    for column, own in config.similarities().items():
        for s in own:
            if s in plain:
                made[f"{column}_{s}"] = plain[s](F.col(f"{column}1"), F.col(f"{column}2"))
    made |= {f"all_texts_{s}": F.lit(0.0) for s in SIMILARITIES}
    made |= {k: similarity.set_distance(F.col(f"{k}1"), F.col(f"{k}2")) for k in KEYWORD_LISTS}
    made["code"] = similarity.code_ratio(F.col("code1"), F.col("code2"))
    both = [similarity.ids_and_codes(F.col(f"all_ids_list{i}"), F.col(f"code{i}")) for i in (1, 2)]
    made["codes_and_ids"] = similarity.code_ratio(*both)
    ids = ["id1", "id2", "all_texts_hash1", "all_texts_hash2"]
    out = materialise(frame.select(*ids, *(c.cast("double").alias(n) for n, c in made.items())), "features")
    pairs = out.select("id1", "id2")
    for column, own in config.similarities().items():
        if "cos" in own or "descriptives" in own:
            out = out.join(_weighted(pairs, left, right, column, own, config), ["id1", "id2"])
    out = out.join(specification_matches(frame, config), ["id1", "id2"])
    if images:
        out = out.join(image_similarities(out, *images, config), ["id1", "id2"])
    return out.select("id1", "id2", "all_texts_hash1", "all_texts_hash2", (birthdate if birthdate is not None else F.date_format(F.current_date(), "yyyy-MM-dd")).alias("birthdate"), *feature_columns(config), *(["hash_similarity"] if images else []))


def _weighted(pairs: DataFrame, left: DataFrame, right: DataFrame, column: str, own: tuple[str, ...], config: Config) -> DataFrame:
    """Cosine and descriptive words of one text column; the corpus is both sides."""
    docs = left.select(F.concat(F.lit("1:"), "id").alias("key"), tfidf.terms_of(F.col(column)).alias("terms")).unionByName(right.select(F.concat(F.lit("2:"), "id").alias("key"), tfidf.terms_of(F.col(column)).alias("terms")))
    w = materialise(tfidf.weights(docs, "key", "terms"), "weights")
    one, two = (w.where(F.col("key").startswith(f"{i}:")).withColumn("key", F.substring("key", 3, 1 << 20)) for i in (1, 2))
    out = pairs
    if "cos" in own:
        out = tfidf.cosine(out, one, two).withColumnRenamed("cos", f"{column}_cos")
    if "descriptives" in own:
        tops = [tfidf.top_terms(side, "key", config.top_words).select(F.col("key").alias(f"id{i}"), F.col("top").alias(f"__top{i}")) for i, side in ((1, one), (2, two))]
        out = out.join(tops[0], "id1", "left").join(tops[1], "id2", "left")
        none = F.array().cast("array<string>")
        out = out.withColumn(f"{column}_descriptives", tfidf.descriptive_overlap(F.coalesce("__top1", none), F.coalesce("__top2", none), config.top_words)).drop("__top1", "__top2")
    return out
