"""Tagging of tokens: units, colours, identifiers, numbers and brands, without state from token to token.

A tag depends on the token and its neighbours only, so every step is one indexed `transform`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.config import MARKS, Config
from pairloom.functions import let
from pairloom.functions.vocab import Vocabulary

#: What Python's float() takes, without the signs of a word.
NUMERIC = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
PARAMETER = r"^(?:[0-9]+[A-Za-z]+|[A-Za-z]+[0-9]+)$"
#: Clothing sizes.
SIZES = ("XS", "S", "M", "L", "XL", "XXL")
NO_TOKENS = "array<string>"


def is_number(token: Column) -> Column:
    return token.rlike(NUMERIC)


def neighbour(tokens: Column, i: Column, by: int) -> Column:
    """The token `by` places on; empty beyond the ends."""
    at = i + F.lit(by)
    return F.coalesce(F.when(at >= 0, F.get(tokens, at)), F.lit(""))


def python_float(value: Column) -> Column:
    """A double as Python writes it: 1.0E16 is 1e+16, 1.0E-5 is 1e-05."""
    return let(value, _python_float)


def _python_float(value: Column) -> Column:
    text = value.cast("string")
    m, e = F.regexp_extract(text, r"^(-?[\d.]+)E(-?\d+)$", 1), F.regexp_extract(text, r"^(-?[\d.]+)E(-?\d+)$", 2).try_cast("int")
    exact = F.when(F.abs(value) < 1e16, F.when(value == F.floor(value), F.concat(value.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"(\.\d*?[1-9])0+$|\.0+$", "$1")))
    power = F.concat(F.regexp_replace(m, r"\.0$", ""), F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(e).cast("string"), 2, "0"))
    small = (F.abs(value) < 1e-4) & (value != 0)
    return F.when(m == "", text).when(small | (F.abs(value) >= 1e16), power).otherwise(exact)


def join_spaced(tokens: Column, names: list[str]) -> Column:
    """Names of several words become one token."""
    text = F.array_join(tokens, " ")
    for name in names:
        text = F.replace(text, F.lit(name), F.lit(name.replace(" ", "")))
    return F.split(text, " ")


def tag_units(tokens: Column, vocabulary: Vocabulary) -> Column:
    """A unit behind a number becomes its base unit, and the number is converted."""
    return let(join_spaced(tokens, vocabulary.spaced_units), lambda t: _tag_units(t, vocabulary))


def _tag_units(tokens: Column, vocabulary: Vocabulary) -> Column:
    factors, bases = vocabulary.unit_maps()
    known = lambda t: F.map_contains_key(factors, F.lower(t))
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, "^([^,]*),", "$1"), r"^([^.]*)\.", "$1").rlike(r"^\p{N}+$")
    sides = lambda t: t.contains("×") & F.forall(F.split(t, "×"), is_number)

    def converted(value: Column, unit: Column) -> Column:
        number = F.regexp_replace(value, ",", ".").try_cast("double") * F.element_at(factors, F.lower(unit))
        return python_float(number)

    def tag(t: Column, i: Column) -> Column:
        before, after = neighbour(tokens, i, -1), neighbour(tokens, i, 1)
        here, ahead = known(t) & (plain(before) | sides(before)), known(after) & (plain(t) | sides(t))
        value = F.when(sides(t), F.array_join(F.transform(F.split(t, "×"), lambda x: converted(x, after)), "×")).otherwise(converted(t, after))
        unit = F.concat(F.lit(MARKS["unit"]), F.element_at(bases, F.lower(t)))
        return F.when(here, F.array(unit)).when(ahead, F.array(value)).when(t.isin(*SIZES), F.array(t, F.lit(MARKS["unit"] + "size"))).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, tag))


def tag_color(token: Column, vocabulary: Vocabulary) -> Column:
    return F.when(F.lower(token).isin(*sorted(vocabulary.colors)), F.concat(F.lit(MARKS["color"]), token)).otherwise(token)


def tag_id(token: Column, following: Column, config: Config, known_words: Column | None = None) -> Column:
    """Long tokens of digits, letters or both that look like identifiers; no unit behind digits."""
    return let(F.regexp_replace(token, r"[^\p{L}\p{N}]", ""), lambda bare: _tag_id(token, bare, following, config, known_words))


def _tag_id(token: Column, bare: Column, following: Column, config: Config, known_words: Column | None) -> Column:
    lower = (F.lower(bare) == bare) & bare.rlike(r"\p{L}")
    marked = bare.rlike("^(?:unit|bnd|col)") & token.startswith("#")
    skip = (F.length(bare) < config.id_length) | lower | marked
    if known_words is not None:
        skip |= F.array_contains(known_words, token)
    digits, letters = bare.rlike(r"^\p{N}+$"), bare.rlike(r"^\p{L}+$")
    found = F.when(digits, ~following.contains(MARKS["unit"])).when(letters, ~bare.rlike("^[A-Z]{2,}")).otherwise(~token.rlike(PARAMETER))
    # a converted value holds a point: only runs of digits, letters or both are identifiers
    return F.when(~skip & ~token.rlike(r"^\d+\.\d+$") & found, F.concat(F.lit(MARKS["id"]), F.translate(token, "()", ""))).otherwise(token)


def tag_number(token: Column, following: Column) -> Column:
    return F.when(is_number(token) & ~following.contains(MARKS["unit"]), F.concat(F.lit(MARKS["number"]), token)).otherwise(token)


def tag_brands(tokens: Column, vocabulary: Vocabulary) -> Column:
    if not vocabulary.brands:
        return tokens
    return F.transform(join_spaced(tokens, vocabulary.spaced_brands), lambda t: F.when(t.isin(*sorted(vocabulary.brands)), F.concat(F.lit(MARKS["brand"]), t)).otherwise(t))


def tag_tokens(tokens: Column, vocabulary: Vocabulary, config: Config = Config(), units=True, colors=True, ids=True, numbers=True, brands=True, known_words: Column | None = None) -> Column:
    """Units, then colour, identifier and number of each token, then brands. No tokens give one empty token.

    known_words: an array of words that are no identifiers.
    """
    tokens = let(tokens, lambda t: F.when(F.size(t) == 0, F.array(F.lit(""))).otherwise(t))
    if units:
        tokens = tag_units(tokens, vocabulary)

    def each(all_tokens: Column) -> Column:
        def tag(t: Column, i: Column) -> Column:
            return let(neighbour(all_tokens, i, 1), lambda following: first_tag(t, following))

        def first_tag(t: Column, following: Column) -> Column:
            """A colour, else an identifier, else a number: the first that changes the token."""
            tried = [F.lit(None)]
            if colors:
                tried.append(F.nullif(tag_color(t, vocabulary), t))
            if ids:
                tried.append(F.nullif(tag_id(t, following, config, known_words), t))
            if numbers:
                tried.append(F.nullif(tag_number(t, following), t))
            return F.when(t.startswith(MARKS["unit"]), t).otherwise(F.coalesce(*tried, t))

        return F.transform(all_tokens, tag)

    tokens = let(tokens, each)
    return tag_brands(tokens, vocabulary) if brands else tokens


def with_mark(tokens: Column, kind: str) -> Column:
    return F.filter(tokens, lambda t: t.contains(MARKS[kind]))


def without_marks(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.regexp_replace(t, "#(?:num|id|bnd|col|unit)#", ""))


def unit_values(tokens: Column) -> Column:
    """Unit and the token in front of it; in front of the first one stands the last."""
    return let(tokens, _unit_values)


def _unit_values(tokens: Column) -> Column:
    pairs = F.transform(tokens, lambda t, i: F.struct(t.alias("unit"), F.when(i > 0, F.get(tokens, i - F.lit(1))).otherwise(F.element_at(tokens, -1)).alias("value")))
    return F.filter(pairs, lambda p: p["unit"].contains(MARKS["unit"]))


def keyword_lists(*columns: Column) -> dict[str, Column]:
    """Units with values, identifiers, numbers and brands of several token columns together."""
    every = F.concat(*columns)
    lists = {f"all_{name}_list": with_mark(every, kind) for name, kind in (("ids", "id"), ("numbers", "number"), ("brands", "brand"))}
    units = F.concat(*(F.transform(unit_values(c), lambda p: F.concat_ws(" ", p["value"], p["unit"])) for c in columns))
    return {"all_units_list": units, **lists}
