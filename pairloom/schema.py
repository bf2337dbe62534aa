"""Schemas of products, pairs, scores and features."""

from __future__ import annotations

from pyspark.sql import types as T

from pairloom.config import KEYWORD_LISTS, SIMILARITIES, Config

SPECIFICATION = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
PRODUCT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "name", "short_description", "long_description")]
    + [T.StructField("specification", SPECIFICATION), T.StructField("price", T.DoubleType()), T.StructField("url", T.StringType()), T.StructField("code", T.ArrayType(T.StringType())), T.StructField("brand", T.StringType()), T.StructField("image_urls", T.ArrayType(T.StringType())), T.StructField("image_count", T.IntegerType())]
)
PAIR = T.StructType([T.StructField("p1", PRODUCT), T.StructField("p2", PRODUCT), T.StructField("match", T.IntegerType())])
SCORE = T.StructType([T.StructField(n, T.StringType()) for n in ("id1", "id2", "all_texts_hash1", "all_texts_hash2")] + [T.StructField("predicted_scores", T.DoubleType()), T.StructField("birthdate", T.StringType())])


def feature_columns(config: Config = Config()) -> list[str]:
    """Names of the model's inputs, always the same whatever the data holds."""
    out = [f"{column}_{s}" for column, own in config.similarities().items() for s in own]
    out += [f"all_texts_{s}" for s in SIMILARITIES]
    return [*out, *KEYWORD_LISTS, "specification_key_matches", "specification_key_value_matches", "code", "codes_and_ids"]
