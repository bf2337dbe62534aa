"""Columns of scraped records: attributes, prices, HTML, urls, discounts, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRINGS = "array<string>"


def squish(*columns: Column) -> Column:
    """Several attributes as one list, without empty ones."""
    return F.filter(F.array(*columns), lambda x: x != "")


def map_attributes(df: DataFrame, mapping: dict[str, str | list[str]]) -> DataFrame:
    """Rename and select what is there: target name to one source name, or to several that become a list."""
    out = []
    for target, source in mapping.items():
        names = [source] if isinstance(source, str) else source
        there = [F.col(f"`{n}`") for n in names if n in df.columns]
        if there:
            out.append((there[0] if isinstance(source, str) else squish(*there)).alias(target))
    return df.select(out)


def specification_of_map(spec: Column) -> Column:
    return F.transform(F.map_entries(spec), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def specification_of_labels(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(e["label"].alias("key"), e["value"].alias("value")))


def formatted_price(price: Column) -> Column:
    return F.coalesce(price["formattedPrice"], F.lit(""))


def scrub_price(price: Column) -> Column:
    """A number from a text whose points and commas are decimal signs; null if none is left."""
    text = F.translate(F.regexp_replace(F.translate(price, ".", ","), "[^0-9,]", ""), ",", ".")
    return text.try_cast("double")


def image_sources(images: Column) -> Column:
    return F.transform(images, lambda x: x["src"])


def flat_codes(codes: Column) -> Column:
    return F.flatten(codes)


def tag_free(html: Column) -> Column:
    """Text without tags, line ends as blanks: a native form for markup without character references."""
    return F.translate(F.regexp_replace(html, "<[^>]*>", ""), "\n", " ")


def is_url(text: Column) -> Column:
    return text.contains("http") | text.contains(".com")


def sku_of(sku: Column, url: Column, before: str = "amazon.sa/dp/") -> Column:
    """A missing SKU is taken from the address."""
    return F.coalesce(F.nullif(sku, F.lit("")), F.split_part(F.split_part(url, F.lit(before), F.lit(2)), F.lit("/"), F.lit(1)))


def original_price(original: Column, net: Column) -> Column:
    return F.when(original.isNull() | F.isnan(original) | (original == 0), net).otherwise(original)


def discount_amount(net: Column, original: Column) -> Column:
    return F.when(net.isNull(), None).when(F.coalesce(original, F.lit(0.0)) == 0, 0.0).otherwise(F.round(original - net, 2))


#: Attributes that name a discount, in their order.
DISCOUNTS = ("bundle", "freeInstallation", "freeItem", "couponDiscount", "bankPromo")


def discount_text(values: dict[str, Column], names: bool) -> Column:
    """Quoted names (or values) of the discounts that are set, comma-joined; empty texts and nulls are not set."""
    return F.concat_ws(",", *(F.when(F.coalesce(v, F.lit("")).isin("", "false", "0", "[]", "{}") == F.lit(False), F.concat(F.lit('"'), F.lit(n) if names else v, F.lit('"'))) for n, v in values.items()))


def discount_value(value: Column, kind: str) -> Column:
    """A discount attribute as text, null if it isn't set (null, empty, zero or false); what isn't text is JSON."""
    if kind == "string":
        return F.nullif(value, F.lit(""))
    if kind == "boolean":
        return F.when(value, F.lit("true"))
    if kind.startswith(("array", "map")):
        return F.when(F.size(value) > 0, F.to_json(value))
    if kind.startswith("struct"):
        return F.to_json(value)
    return F.when(value != 0, value.cast("string"))


def discount_list(values: dict[str, Column], names: bool) -> Column:
    """Quoted names (or values) of the discounts that are set, comma-joined."""
    return F.concat_ws(",", *(F.when(v.isNotNull(), F.concat(F.lit('"'), F.lit(n) if names else v, F.lit('"'))) for n, v in values.items()))


def mapped_label(match_type: Column) -> Column:
    return F.coalesce((match_type == "match").cast("int"), F.lit(0))


def strip_brackets(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^\[ ", ""), r" \]$", "")


def hamming(a: Column, b: Column) -> Column:
    """Places in which two texts differ, over the length of the shorter one."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))


def same_model(name1: Column, name2: Column, id1: Column, id2: Column, brand: Column) -> Column:
    """False for matches that ids or names of the same brand contradict. Ids of fewer than two signs contradict nothing."""
    apple = F.coalesce(F.lower(brand) == "apple", F.lit(False))
    size1, size2 = (F.regexp_extract(F.lower(n), r"(\d+)\s?gb", 1) for n in (name1, name2))
    both = (F.length(id1) > 0) & (F.length(id2) > 0)
    known = F.coalesce(both, F.lit(False))
    wrong = apple & known & (id1 != id2)
    wrong |= apple & (F.lower(name1).rlike(r"\Wmax\W") != F.lower(name2).rlike(r"\Wmax\W"))
    wrong |= apple & (size1 != "") & (size2 != "") & (size1 != size2)
    near = (F.length(id1) > 1) & (F.length(id2) > 1) & (F.substring(id1, 1, 2) == F.substring(id2, 1, 2)) & (hamming(id1, id2) > 2)
    return ~F.coalesce(wrong | F.coalesce(near, F.lit(False)), F.lit(False))
