"""Vocabularies of units, currencies, colours and brands, from files or from small built-in lists.

File formats: units (name, plural, local names, shortcuts, prefixes; tab-separated, lists by comma), prefixes (name, local
name, sign, value), currencies (name, other name, shortcut, symbols), conversions (shortcut, value, base, name), colours
(one a line), brands (JSON list).
"""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Basic units with their prefixes, and factors to metric base units.
UNITS = {"m": ("meter", "meters", ("p", "n", "μ", "m", "c", "d", "k")), "g": ("gram", "grams", ("m", "c", "k")), "s": ("second", "seconds", ("p", "n", "μ", "m")), "l": ("liter", "liters", ("m", "c", "d", "h")), "w": ("watt", "watts", ("m", "k", "M", "G")), "v": ("volt", "volts", ("m", "k")), "a": ("ampere", "amperes", ("m", "k")), "hz": ("hertz", "hertz", ("k", "M", "G")), "b": ("byte", "bytes", ("k", "M", "G", "T")), "pcs": ("piece", "pieces", ()), "%": ("percent", "percent", ())}
PREFIXES = {"p": 1e-12, "n": 1e-9, "μ": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}
CONVERSIONS = {"inch": (0.0254, "m"), "in": (0.0254, "m"), "ft": (0.3048, "m"), "yd": (0.9144, "m"), "mi": (1609.344, "m"), "lb": (453.59237, "g"), "oz": (28.349523125, "g"), "gal": (3.785, "l")}
COLORS = ("black", "blue", "brown", "gold", "green", "grey", "orange", "pink", "purple", "red", "silver", "white", "yellow")


@dataclass(frozen=True)
class Vocabulary:
    """units: token to (factor, base unit), conversions included; spaced: unit names of several words."""

    units: dict[str, tuple[float, str]]
    colors: frozenset[str]
    brands: frozenset[str]

    @property
    def spaced_units(self) -> list[str]:
        return sorted(u for u in self.units if " " in u)

    @property
    def spaced_brands(self) -> list[str]:
        return sorted(b for b in self.brands if " " in b)

    def unit_maps(self) -> tuple[Column, Column]:
        """Factors and base units by token, as map columns."""
        names = sorted(self.units)
        value = F.create_map(*chain.from_iterable((F.lit(u.replace(" ", "")), F.lit(self.units[u][0])) for u in names))
        base = F.create_map(*chain.from_iterable((F.lit(u.replace(" ", "")), F.lit(self.units[u][1])) for u in names))
        return value, base


def clean_vocabulary(colors=COLORS, brands=()) -> Vocabulary:
    """The built-in lists; a prefixed unit never replaces a basic or converted one."""
    units: dict[str, tuple[float, str]] = {}
    for short, (name, plural, prefixes) in UNITS.items():
        for n in (short, name, plural):
            units[n] = (1.0, short)
    for name, (factor, base) in CONVERSIONS.items():
        units.setdefault(name, (factor, base))
    for short, (_, _, prefixes) in UNITS.items():
        for p in prefixes:
            units.setdefault((p + short).lower(), (PREFIXES[p], short))
    return Vocabulary(units, frozenset(colors), frozenset(b.lower() for b in brands) | frozenset(b.lower().replace(" ", "") for b in brands))


def _rows(path: str) -> list[list[str]]:
    with open(path, encoding="utf-8", newline="") as f:
        return [r + [""] * 5 for r in list(csv.reader(f, delimiter="\t", quoting=csv.QUOTE_NONE))[1:]]


def vocabulary_from_files(units: str, prefixes: str, currencies: str, conversions: str, colors: str, brands: str, compat: bool = False) -> Vocabulary:
    """compat: later rows replace earlier ones of the same name, currencies replace units, and prefixes are lower-cased."""
    value = {r[2]: float(r[3]) for r in _rows(prefixes)}
    table: dict[str, tuple[float, str]] = {}

    def put(name: str, entry: tuple[float, str]) -> None:
        name = name.lower() if compat else name.lower().strip()
        if name and (compat or name not in table):
            table[name] = entry

    for r in _rows(units):
        shorts = [s for s in r[3].split(",") if s]
        base = (shorts[0] if shorts else r[0]).lower().strip()
        for n in (*shorts, r[0], r[1], *r[2].split(",")):
            put(n, (1.0, base))
        for p in filter(None, r[4].split(",")):
            for n in shorts:
                put(p + n, (value.get(p, 1.0), base))
    for r in _rows(currencies):
        names = [r[0], r[1], *r[2].split(","), *r[3].split(",")]
        for n in names:
            put(n, (1.0, r[0].lower()))
    for r in _rows(conversions):
        if compat or r[0].lower() not in table:
            table[r[0].lower()] = (float(r[1]), r[2].lower())
    with open(colors, encoding="utf-8") as f:
        shades = {line.strip() for line in f if line.strip()}
    shades |= {c[:-1] + e for c in shades if c.endswith("á") for e in "ýé"}
    with open(brands, encoding="utf-8") as f:
        makes = [b.lower() for b in json.load(f)]
    return Vocabulary(table, frozenset(shades), frozenset(makes) | frozenset(b.replace(" ", "") for b in makes))
