"""Licence scan by ordered signature rules.

A document's bytes are lower-cased (A-Z only). Keywords are looked for first, in one pass; a rule is tried only where its
keyword is. A place that lies inside another one of a higher class, or inside a longer one of its own, is suppressed. Beside the rules, the base phrases are found at all their places, and their labels always stay.

Words are runs of digits, letters a-z and all characters beyond ASCII, counted from 0.

Defined results: null and empty texts have no word, no label (empty strings), null places and score 0; rules that find
the same place and class go by label; repeated rows are scanned each; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.llm.common import map_texts
from pairloom.llm.license_rules import RULES
from pairloom.llm.shingles import IN_WORD

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: How sure a place of each class is that the text is under this licence.
SURE = (0.5, 0.6, 0.8, 0.85, 0.95, 0.99)
CHAR = r"[0-9a-z\x80-\xff]"
BETWEEN = r"[^0-9a-z\x80-\xff]+"


def compiled(pattern: str) -> re.Pattern:
    return re.compile(f"(?<!{CHAR}){pattern.replace(' ?', f'(?:{BETWEEN})?').replace(' ', BETWEEN)}(?!{CHAR})")


@functools.lru_cache(maxsize=1)
def rules() -> tuple[dict[str, list[tuple[int, str, re.Pattern]]], object]:
    """Rules by keyword, and the automaton that finds keywords."""
    import ahocorasick

    by_word: dict[str, list] = {}
    for line in RULES.strip().splitlines():
        label, kind, word, pattern = line.split(" ", 3)
        by_word.setdefault(word, []).append((int(kind), label, compiled(pattern)))
    for phrase, _ in BASE:
        by_word.setdefault(phrase.split()[0], [])
    automaton = ahocorasick.Automaton()
    for word in by_word:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return by_word, automaton


@functools.lru_cache(maxsize=1)
def base_patterns() -> list[tuple[str, str, re.Pattern]]:
    return [(phrase.split()[0], label, compiled(phrase)) for phrase, label in BASE]


def detections(lowered: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, str]]]:
    """(start, end, class, label) of the places that stay, in order, and (start, label) of every base place."""
    by_word, automaton = rules()
    words = {w for _, w in automaton.iter(lowered)}
    if not words:
        return [], []
    found = [(m.start(), m.end(), kind, label) for w in words for kind, label, pattern in by_word[w] for m in pattern.finditer(lowered)]
    # a place goes if one of its class or a higher one spans it: by start, the longest first, the largest end of each class tells
    kept: list[tuple[int, int, int, str]] = []
    reach = [0] * len(SURE)
    for a, b, kind, label in sorted(found, key=lambda f: (f[0], -f[1], -f[2], f[3])):
        if max(reach[kind:]) < b:
            kept.append((a, b, kind, label))
        reach[kind] = max(reach[kind], b)
    base = [(m.start(), label) for w, label, pattern in base_patterns() if w in words for m in pattern.finditer(lowered)]
    return kept, sorted(base)


def scan_text(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, places (label, class, start and end byte)."""
    raw = text.encode("utf-8", "replace").lower()
    mask = IN_WORD[np.frombuffer(raw, np.uint8)]
    starts = np.flatnonzero(mask & ~np.concatenate([[False], mask[:-1]])) if len(mask) else np.empty(0, np.int64)
    kept, base = detections(raw.decode("latin1"))
    at = np.searchsorted(starts, [a for a, _ in base]).tolist()
    own = sorted({label for _, label in base})
    labels = sorted({label for *_, label in kept} | set(own))
    score = 1 - float(np.prod([1 - SURE[kind] for _, _, kind, _ in kept] + [1 - SURE[1]] * (bool(base) and not kept)))
    return len(starts), len(base), at[0] if at else None, at[-1] if at else None, ",".join(own), ",".join(labels), score, [{"label": label, "kind": kind, "start": a, "end": b} for a, b, kind, label in kept]


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("places", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and what the scan finds: counts, labels, score and the places that stay."""
    return map_texts(docs, text, keep, FIELDS, lambda texts: list(zip(*map(scan_text, texts), strict=True)))
