"""Quality by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and so has each of some pairs of features. The tables are sums of
shallow trees on one feature (or one pair) at a time, fitted to the gradient of the logistic loss in turns around all
features with a small rate. A document's score adds the entries of its bins.

Defined results: null and empty texts have all features 0 and are scored as such; repeated rows are scored each, in
learning one text of each id and label counts; without labels of both kinds the score is the share of good labels (0.5 without any); an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import itertools
import operator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.llm.common import map_texts, sample_texts

FEATURES = ("characters", "words", "word_length", "long_word", "letters", "capitals", "digits", "blanks", "marks", "exclamations", "symbols", "bars", "other_bytes", "distinct_words", "repeated_next", "distinct_pairs", "first_word", "lines", "line_length", "repeated_lines", "sentence_length", "short_words")


def byte_classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[[*range(97, 123)]] = 1
    kind[[*range(65, 91)]] = 2
    kind[[*range(48, 58)]] = 3
    kind[[9, 10, 13, 32]] = 4
    kind[[ord(c) for c in ".,;:?'\"()-"]] = 5
    kind[ord("!")] = 6
    kind[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 7
    kind[ord("|")] = 8
    kind[128:] = 9
    return kind


KIND = byte_classes()


def features(text: str) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = np.bincount(KIND[raw], minlength=10) / len(raw)
    words, lines = text.split(), text.split("\n")
    k = max(len(words), 1)
    lengths = list(map(len, words))
    distinct = set(words)
    following = words[1:]
    letters = max(n[1] + n[2] + n[9], 1e-9)
    ends = text.count(".") + text.count("!") + text.count("?")
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(lengths) / k, max(lengths, default=0),
        letters, n[2] / letters, n[3], n[4], n[5], n[6], n[7], n[8], n[9],
        len(distinct) / k, sum(map(operator.eq, words, following)) / k, len(set(zip(words, following, strict=False))) / k, words.count(words[0]) / k if words else 0.0,
        np.log1p(len(lines)), len(text) / len(lines), 1 - len(set(lines)) / len(lines), k / (ends + 1), sum(x <= 3 for x in lengths) / k,
    ]


class AdditiveModel:
    """cuts: borders of each feature's bins; tables: by feature; pairs and pair_tables: on coarser bins."""

    def __init__(self, bins: int = 48, coarse: int = 8):
        self.bins, self.coarse = bins, coarse
        self.intercept, self.cuts, self.tables, self.pairs, self.pair_tables = 0.0, [], [], [], []

    def _binned(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1)

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray, least: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
        """Values of a tree over ordered bins: the best cut, then the best in what is left, up to `leaves`."""
        G, H, N = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, least))
        worth = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
        edges = [0, len(g)]
        for _ in range(leaves - 1):
            best = (1e-9, None)
            for a, b in itertools.pairwise(edges):
                c = np.arange(a + 1, b)
                c = c[(N[c] - N[a] >= 5) & (N[b] - N[c] >= 5)]
                if len(c):
                    gain = worth(a, c) + worth(c, b) - worth(a, b)
                    best = max(best, (float(gain.max()), int(c[gain.argmax()])), key=lambda t: t[0])
            if best[1] is None:
                break
            edges = sorted([*edges, best[1]])
        out = np.zeros(len(g))
        for a, b in itertools.pairwise(edges):
            out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
        return out

    @staticmethod
    def _quarters(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
        """The best cross of one cut on each axis, and its gain."""
        G, H = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
        best, n = (0.0, np.zeros_like(g)), len(g)
        for i in range(1, n):
            for j in range(1, n):
                out, gain = np.zeros_like(g), -G[n, n] ** 2 / (H[n, n] + ridge)
                for a, b in ((0, i), (i, n)):
                    for c, d in ((0, j), (j, n)):
                        s, t = (M[b, d] - M[a, d] - M[b, c] + M[a, c] for M in (G, H))
                        out[a:b, c:d] = s / (t + ridge)
                        gain += s * s / (t + ridge)
                if gain > best[0]:
                    best = (gain, out)
        return best

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 20, n_pairs: int = 5, rate: float = 0.12) -> AdditiveModel:
        y = np.asarray(y, float)
        p = float(y.mean()) if len(y) else 0.5
        self.intercept = float(np.log(max(p, 1e-3) / max(1 - p, 1e-3)))
        if not len(y) or p in (0.0, 1.0):
            return self
        quantiles = lambda n: [np.unique(np.quantile(x[:, f], np.arange(1, n) / n)) for f in range(x.shape[1])]
        self.cuts, self.coarse_cuts = quantiles(self.bins), quantiles(self.coarse)
        at, score = self._binned(x, self.cuts), np.full(len(y), self.intercept)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        counts = [np.bincount(at[:, f], minlength=len(t)) for f, t in enumerate(self.tables)]

        def slopes():
            q = 1 / (1 + np.exp(-score))
            return y - q, np.maximum(q * (1 - q), 1e-6)

        for _ in range(rounds):
            for f, table in enumerate(self.tables):
                g, h = slopes()
                step = rate * self._tree(np.bincount(at[:, f], g, len(table)), np.bincount(at[:, f], h, len(table)), counts[f])
                table += step
                score += step[at[:, f]]
        rough, m = self._binned(x, self.coarse_cuts), self.coarse
        cells = {(a, b): rough[:, a] * m + rough[:, b] for a, b in itertools.combinations(range(x.shape[1]), 2)}
        grid = lambda c, v: np.bincount(c, v, m * m).reshape(m, m)
        g, h = slopes()
        gains = {k: float((grid(c, g) ** 2 / (grid(c, h) + 1)).sum()) for k, c in cells.items()}
        self.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]
        self.pair_tables = [np.zeros((m, m)) for _ in self.pairs]
        for _ in range(pair_rounds):
            for k, table in zip(self.pairs, self.pair_tables, strict=True):
                g, h = slopes()
                step = rate * self._quarters(grid(cells[k], g), grid(cells[k], h))[1]
                table += step
                score += step.ravel()[cells[k]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Sums of the tables' entries, as probabilities."""
        total = np.full(len(x), self.intercept)
        if self.tables and len(x):
            at = self._binned(x, self.cuts)
            for f, table in enumerate(self.tables):
                total += table[at[:, f]]
            rough = self._binned(x, self.coarse_cuts)
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-total))


def feature_rows(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, most: int = 6000, fold: int = 5, held_out: int = 0, label: str = "quality") -> AdditiveModel:
    """Tables from at most `most` labelled documents whose id isn't in the held-out fold; executors make their features."""
    rows = sample_texts(docs, labels, label, most, fold, held_out)
    made = map_texts(rows, "text", ["key", "label"], [T.StructField("x", T.ArrayType(T.DoubleType()))], lambda texts: [feature_rows(texts).tolist()])
    found = sorted((r["key"], int(r["label"]), r["x"]) for r in made.collect())
    return AdditiveModel().fit(np.array([r[2] for r in found], float).reshape(len(found), len(FEATURES)), np.array([r[1] for r in found], float))


def score_documents(docs: DataFrame, model: AdditiveModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and score, the likelihood that a document is good."""
    return map_texts(docs, text, keep, [T.StructField("score", T.DoubleType())], lambda texts: [model.score(feature_rows(texts))])


def keep_good(docs: DataFrame, model: AdditiveModel, least: float = 0.3, text: str = "text") -> DataFrame:
    """The documents, all columns, that score at least `least`."""
    return map_texts(docs, text, docs.columns, [], lambda texts: model.score(feature_rows(texts)), lambda score: (score >= least).tolist())
