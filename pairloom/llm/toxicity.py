"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence has a logistic score over its words and word beginnings; a document is toxic if any sentence is, by
noisy-or: 1 minus the product of (1 - sentence score). Weights are fitted to document labels through that product, so
the sentences that make a document toxic are found without sentence labels.

Bounds: at most `most` labelled documents are learnt from. Every feature in three of them or more that tells is kept.

Defined results: null and empty texts score 0 (no sentence); repeated rows are scored each, in learning one text of each
id and label counts; of sentences that score alike the first is the worst; without labels of both kinds every score is 0;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import WORD, map_texts, sample_texts

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$")
#: Beginnings of words that are features beside the words: inflected and compounded forms share them.
PREFIXES = (4, 5)


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def features_in(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def telling(held: float, toxic: float, n: int, share: float) -> float:
    """Chi-square of a feature that `held` of n documents hold, `toxic` of them toxic, where `share` of all are."""
    return (toxic - held * share) ** 2 / max(held * share * (1 - share) * (1 - held / (n + 1)), 1e-9)


#: Features in so many documents and of at least this chi-square get a weight.
LEAST_DOCS, LEAST_TELLING = 3, 6.6


def bag_of(text: str, index: dict[str, int]) -> tuple[int, list[list[int]]]:
    """How many sentences of a text hold words but no known feature, and the known features of each other one."""
    plain, bags = 0, []
    for s in SENTENCE.findall(text.lower()):
        if words := set(WORD.findall(s)):
            own = sorted(index[f] for f in features_in(words) if f in index)
            if own:
                bags.append(own)
            else:
                plain += 1
    return plain, bags


class NoisyOr:
    """weights: by feature; bias: of a sentence without any."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.bias = -60.0

    def fit(self, texts: list[str], labels: list[int]) -> NoisyOr:
        """Weights from texts in memory; `learn` does the same with the texts left on the executors."""
        y = np.array(labels, bool)
        if not y.any() or y.all():
            return self
        held: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        for text, bad in zip(texts, y, strict=True):
            own = features_in(set(WORD.findall(text.lower())))
            held.update(own)
            if bad:
                toxic.update(own)
        names = sorted(f for f, c in held.items() if c >= LEAST_DOCS and telling(c, toxic[f], len(y), y.mean()) > LEAST_TELLING)
        index = {f: k for k, f in enumerate(names)}
        return self.fit_bags(names, [bag_of(t, index) for t in texts], labels)

    def fit_bags(self, names: list[str], bags: list[tuple[int, list[list[int]]]], labels: list[int], l1: float = 2e-4, steps: int = 250, rate: float = 0.15) -> NoisyOr:
        """names: of the features; bags: of each document, as bag_of gives them. Gradient steps on the noisy-or likelihood."""
        y = np.array(labels, bool)
        if not y.any() or y.all():
            return self
        n = len(y)
        plain = np.array([p for p, _ in bags], float)
        owner = np.repeat(np.arange(n), [len(own) for _, own in bags])
        sizes = np.array([len(s) for _, own in bags for s in own], np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        feature = np.fromiter((k for _, own in bags for s in own for k in s), np.int64, int(sizes.sum()))
        w, b, m, v = np.zeros(len(names)), -8.0, np.zeros(len(names) + 1), np.zeros(len(names) + 1)
        for t in range(1, steps + 1):
            z = b + np.bincount(row, w[feature], len(sizes))
            total = np.maximum(np.bincount(owner, np.logaddexp(0, z), n) + plain * np.logaddexp(0, b), 1e-12)  # -log(1 - P)
            slope = np.where(y, -1 / np.expm1(np.minimum(total, 50)), 1.0) / n
            each = slope[owner] / (1 + np.exp(-z))
            g = np.append(np.bincount(feature, each[row], len(names)), each.sum() + (slope * plain).sum() / (1 + np.exp(-b)))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
            w = w - step[:-1]
            w = np.sign(w) * np.maximum(np.abs(w) - l1 * rate * 50, 0)
            b = min(b - step[-1], -6.0)
        self.weights, self.bias = {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(b)
        return self

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and score of every sentence."""
        out = []
        for m in SENTENCE.finditer(text):
            z = self.bias + sum(self.weights.get(f, 0.0) for f in {f for w in set(WORD.findall(m[0].lower())) for f in features_of(w)})
            out.append((m.start(), m.end(), 1 / (1 + np.exp(-z))))
        return out

    def scorer(self, cached: int = 200_000):
        """A function from texts to scores, which remembers the words that have no weight: most texts hold no other."""
        plain: set[str] = set()

        def any_weight(words: set[str]) -> bool:
            found = False
            for w in words - plain:
                if any(f in self.weights for f in features_of(w)):
                    found = True
                elif len(plain) < cached:
                    plain.add(w)
            return found

        def score(texts: list[str]) -> tuple[list[float], list[int]]:
            out, worst = [], []
            for text in texts:
                if any_weight(set(WORD.findall(text.lower()))):
                    each = np.array([s for _, _, s in self.sentences(text)])
                    out.append(float(1 - np.prod(1 - each)))
                    worst.append(int(np.argmax(each)))
                else:
                    n = len(SENTENCE.findall(text))
                    out.append(float(-np.expm1(-n * np.logaddexp(0, self.bias))))
                    worst.append(-1)
            return out, worst

        return score


def learn(docs: DataFrame, labels: DataFrame, most: int = 6000, fold: int = 5, held_out: int = 0, label: str = "toxic") -> NoisyOr:
    """Weights from at most `most` labelled documents whose id isn't in the held-out fold.

    Executors take the texts apart: features are counted in a shuffle, the driver gets those that tell, and then of each
    document the telling features of its sentences.
    """
    rows = sample_texts(docs, labels, label, most, fold, held_out)
    n, bad = rows.agg(F.count("*"), F.sum(F.when(F.col("label") != 0, 1).otherwise(0))).first()
    if not bad or bad == n:
        return NoisyOr()
    words = map_texts(rows, "text", ["label"], [T.StructField("f", T.ArrayType(T.StringType()))], lambda texts: [[list(features_in(set(WORD.findall(t.lower())))) for t in texts]])
    counted = words.select((F.col("label") != 0).cast("int").alias("bad"), F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("held"), F.sum("bad").alias("toxic"))
    expected = F.col("held") * (bad / n)
    able = counted.where((F.col("held") >= LEAST_DOCS) & ((F.col("toxic") - expected) ** 2 / F.greatest(expected * (1 - bad / n) * (1 - F.col("held") / (n + 1)), F.lit(1e-9)) > LEAST_TELLING))
    names = sorted(r["f"] for r in able.select("f").collect())
    index = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})
    fields = [T.StructField("plain", T.IntegerType()), T.StructField("bags", T.ArrayType(T.ArrayType(T.IntegerType())))]
    bags = map_texts(rows, "text", ["key", "label"], fields, lambda texts: list(zip(*(bag_of(t, index.value) for t in texts), strict=True)))
    found = sorted((r["key"], int(r["label"] != 0), r["plain"], r["bags"]) for r in bags.collect())
    return NoisyOr().fit_bags(names, [(p, own) for _, _, p, own in found], [r[1] for r in found])


def score_documents(docs: DataFrame, model: NoisyOr, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, score and worst (the number of the sentence that scores most, -1 if none has a weight)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("worst", T.IntegerType())]
    made: dict = {}

    def score(texts):
        if "f" not in made:
            made["f"] = model.scorer()
        return made["f"](texts)

    return map_texts(docs, text, keep, fields, score)


def offending_sentences(docs: DataFrame, model: NoisyOr, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """key, number, start, end, score, sentence of every sentence that scores at least `least`."""
    fields = [T.StructField("hits", T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("sentence", T.StringType())])))]

    def find(texts):
        return [[[{"number": i, "start": a, "end": b, "score": float(s), "sentence": t[a:b]} for i, (a, b, s) in enumerate(model.sentences(t)) if s >= least] for t in texts]]

    hits = map_texts(docs, text, [key], fields, find).toDF("key", "hits")
    return hits.select("key", F.explode("hits").alias("hit")).select(F.col("key").alias(key), "hit.*")
