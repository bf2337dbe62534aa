"""The few functions without a built-in form, as Arrow batches; apply them to distinct inputs where values repeat."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkd_each(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition of every text of an array."""
    return texts.map(lambda ts: [t if t is None or t.isascii() else unicodedata.normalize("NFKD", t) for t in ts], na_action="ignore")


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; null with a null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


def _strip(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts).replace("\n", " ")


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """All text of a fragment, line ends as blanks."""
    return html.map(_strip, na_action="ignore")


_PRICE = re.compile(r"\d[\d.,\s ']*")


def parse_price(text: str) -> float | None:
    """The first number of a free price text. The last separator with one or two digits behind it is the decimal point."""
    m = _PRICE.search(text)
    if not m:
        return None
    digits = re.sub(r"[\s ']", "", m[0]).rstrip(".,")
    head, sign, tail = digits.rpartition(max(digits.rfind("."), digits.rfind(",")) >= 0 and digits[max(digits.rfind("."), digits.rfind(","))] or "\0")
    if sign and (len(tail) in (1, 2) or (len(tail) != 3 and digits.count(sign) == 1)):
        return float(re.sub("[.,]", "", head) + "." + tail)
    return float(re.sub("[.,]", "", digits))


@F.pandas_udf(T.DoubleType())
def price_of_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: parse_price(t) if t else None, na_action="ignore").astype("float64")


_VOWELS = "aeiouy"


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions behind a vowel and a consonant begin."""
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        m = re.search(f"[{_VOWELS}][^{_VOWELS}]", word)
        first = m.end() if m else len(word)
    m = re.search(f"[{_VOWELS}][^{_VOWELS}]", word[first:])
    return first, first + m.end() if m else len(word)


def _short_syllable(word: str) -> bool:
    return bool(re.search(f"[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY]$|^[{_VOWELS}][^{_VOWELS}]$", word))


#: Exceptions and endings of the public English (Porter2) stemming rules.
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """English stem by the Porter2 rules."""
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    word = re.sub(f"(^|[{_VOWELS}])y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = re.sub("('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWELS}].+s$", word):
        word = word[:-1]
    if word in _KEPT:
        return word
    if m := re.search("(eedly|eed)$", word):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", word)) and re.search(f"[{_VOWELS}]", word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif _short_syllable(word) and r1 >= len(word):
            word += "e"
    if re.search(f".[^{_VOWELS}][yY]$", word):
        word = word[:-1] + "i"
    for ending, new in _STEP2:
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r1 and (ending != "ogi" or word[at - 1] == "l") and (ending != "li" or word[at - 1] in "cdeghkmnrt"):
                word = word[:at] + new
            break
    for ending, new in _STEP3:
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r1 and (ending != "ative" or at >= r2):
                word = word[:at] + new
            break
    for ending in _STEP4:
        if word.endswith(ending):
            at = len(word) - len(ending)
            if at >= r2 and (ending != "ion" or word[at - 1] in "st"):
                word = word[:at]
            break
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: [stem(t) for t in ts], na_action="ignore")


# not deterministic: so that the optimiser leaves them where they stand, and never moves them into a function of array elements
nfkd, nfkd_each, stem_tokens = (f.asNondeterministic() for f in (nfkd, nfkd_each, stem_tokens))
