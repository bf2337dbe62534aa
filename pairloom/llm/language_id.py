"""Language identification with hyperdimensional profiles.

Every letter has a random vector of -1 and 1. A trigram is the product of its letters' vectors, each rolled by its
distance to the end (binding with permutation); a text is the sum of its trigrams (bundling); a language is the sum of
its learning texts, each at unit length. A text takes the language whose prototype is nearest by cosine.

Texts are lower-cased; each run of anything but letters counts as one blank, which has a vector as well. Every letter of
Unicode has a vector, whether a learning text holds it or not: its own below U+0600, by a hash of its code point beyond.

Bounds: at most `most` labelled documents are learnt from.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the first language in
alphabetical order; without any labelled row every text is `und`; an empty table gives no rows; repeated rows are
predicted each, in learning one text of each id and language counts; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.llm.common import map_texts, sample_texts
from pairloom.llm.shingles import mix

UND = "und"


#: Letters with a vector of their own by code point, and the vectors that all other letters share by a hash of theirs.
OWN_CODES, SHARED = 1536, 2560


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """The vector's number of each code point: 0 for what is no letter."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    codes = np.arange(0x110000, dtype=np.uint64)
    number = np.where(codes < OWN_CODES, codes, OWN_CODES + mix(codes) % np.uint64(SHARED)).astype(np.int16)
    return np.where(letter, number, 0).astype(np.int16)


@functools.lru_cache(maxsize=2)
def letter_vectors(dims: int, seed: int) -> list[np.ndarray]:
    """Random vectors of the blank and all letters, rolled for the first, second and third place of a trigram."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (OWN_CODES + SHARED, dims))
    return [np.roll(base, k, axis=1) for k in (2, 1, 0)]


class Profiles:
    """Prototypes of languages. dims: length of the vectors; seed: of the letters' vectors."""

    def __init__(self, dims: int = 1024, seed: int = 7, block: int = 256, columns: int = 8192):
        self.dims, self.seed, self.block, self.columns = dims, seed, block, columns
        self.languages: list[str] = []

    @staticmethod
    def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Vector numbers of all texts' letters and blanks one behind the other, and the text of each."""
        encoded = [t.lower().encode("utf-32-le", "replace") for t in texts]
        codes = np.frombuffer(b"".join(x + b" \0\0\0" for x in encoded), np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(x) // 4 + 1 for x in encoded])
        number = letter_table()[codes]
        keep = number > 0
        keep[1:] |= number[:-1] > 0  # the first of each run of blanks
        return number[keep].astype(np.int64), owner[keep]

    def vectors(self, texts: list[str]) -> np.ndarray:
        """The bundled vector of each text: counts of trigrams times the trigrams' vectors."""
        out = np.zeros((len(texts), self.dims), np.float32)
        first, second, third = letter_vectors(self.dims, self.seed)
        for a in range(0, len(texts), self.block):
            part = texts[a : a + self.block]
            s, owner = self.symbols(part)
            s, owner = np.concatenate([[0], s]), np.concatenate([[-1], owner])  # a blank in front of the first
            if len(s) < 3:
                continue
            present = np.flatnonzero(np.bincount(s, minlength=OWN_CODES + SHARED))
            n, local = len(present), np.zeros(OWN_CODES + SHARED, np.int64)
            local[present] = np.arange(n)
            s = local[s]
            trigram, whose = (s[:-2] * n + s[1:-1]) * n + s[2:], owner[1:-1]
            whole = owner[1:-1] == owner[2:]
            trigram, whose = trigram[whole], whose[whole]
            if n**3 <= 1 << 22:
                there = np.flatnonzero(np.bincount(trigram, minlength=n**3))
                place = np.zeros(n**3, np.int64)
                place[there] = np.arange(len(there))
                place = place[trigram]
            else:
                there, place = np.unique(trigram, return_inverse=True)
            for c in range(0, len(there), self.columns):
                some = there[c : c + self.columns]
                mine = slice(None) if len(there) <= self.columns else (place >= c) & (place < c + len(some))
                counts = np.bincount(whose[mine] * len(some) + place[mine] - c, minlength=len(part) * len(some)).reshape(len(part), len(some))
                grams = first[present[some // (n * n)]] * second[present[some // n % n]] * third[present[some % n]]
                out[a : a + len(part)] += counts.astype(np.float32) @ grams.astype(np.float32)
        return out

    def unit(self, texts: list[str]) -> np.ndarray:
        v = self.vectors(texts)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def fit(self, texts: list[str], languages: list[str]) -> Profiles:
        return self.fit_vectors(self.unit(texts), languages)

    def fit_vectors(self, units: np.ndarray, languages: list[str]) -> Profiles:
        """units: the learning texts' vectors at unit length."""
        self.languages = sorted(set(languages))
        which = np.array([self.languages.index(x) for x in languages], np.int64)
        sums = np.zeros((len(self.languages), self.dims), np.float64)
        np.add.at(sums, which, units)
        self.prototypes = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        return self

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UND] * len(texts), [0.0] * len(texts)
        cosine = self.unit(texts).astype(np.float64) @ self.prototypes.T
        best = np.argmax(cosine, axis=1)
        letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        score = np.where(letters, np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
        return [self.languages[b] if k else UND for b, k in zip(best, letters, strict=True)], score.tolist()


def learn(docs: DataFrame, most: int = 6000, fold: int = 3, held_out: int = 1, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Prototypes from at most `most` documents of known language whose id isn't in the held-out fold; executors make their vectors."""
    model = Profiles()
    rows = sample_texts(docs, docs, lang, most, fold, held_out, key, text)
    made = map_texts(rows, "text", ["key", "label"], [T.StructField("v", T.ArrayType(T.FloatType()))], lambda texts: [list(model.unit(texts))]).toArrow()
    if not made.num_rows:
        return model
    order = sorted(range(made.num_rows), key=lambda i, k=made.column("key").to_pylist(), n=made.column("label").to_pylist(): (k[i], str(n[i])))
    units = made.column("v").combine_chunks().flatten().to_numpy().reshape(made.num_rows, model.dims)[order]
    names = made.column("label").to_pylist()
    return model.fit_vectors(units, [str(names[i]) for i in order])


def identify(docs: DataFrame, model: Profiles, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, lang_pred and score of every document."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_texts(docs, text, keep, fields, model.predict)


def keep_identified(docs: DataFrame, model: Profiles, least: float = 0.1, least_short: float = 0.03, short: int = 100, text: str = "text") -> DataFrame:
    """The documents, all columns, whose language is found: those that are `und` or under the least cosine go.

    Vectors of unrelated texts have cosines of about 1 / sqrt(dims), 0.03, the largest of several languages up to 0.1. Texts
    under `short` characters hold too few trigrams to tell by, and go only under `least_short`.
    """

    def found(texts: list[str]) -> list[bool]:
        return [lang != UND and score >= (least_short if len(t) < short else least) for lang, score, t in zip(*model.predict(texts), texts, strict=True)]

    return map_texts(docs, text, docs.columns, [], found, lambda kept: kept)
