"""Classifiers of pairs with one interface: fit(df) gives a model, model.score(df) adds `score` and `predicted_match`.

Models without a counterpart in Spark ML: a polynomial support vector machine is a linear one on the products of features,
or on a tensor sketch of them where there are more than SKETCH, its score a logistic function of the margin; AdaBoost is SAMME over weighted logistic regressions; neural networks train by
L-BFGS with sigmoid units. They are to be compared by their metrics.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import feature as X
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.config import Config
from pairloom.operators import evaluation
from pairloom.operators.relational import hash_split, weighted_sample
from pairloom.sources import writers

#: Default settings of each model.
DEFAULTS = {
    "LinearRegression": {},
    "LogisticRegression": {"maxIter": 50, "regParam": 0.0},
    "SupportVectorMachine": {"degree": 5, "maxIter": 100, "regParam": 0.01},
    "DecisionTree": {"impurity": "entropy", "maxDepth": 10, "minInstancesPerNode": 3},
    "RandomForest": {"impurity": "entropy", "maxDepth": 10, "numTrees": 100, "minInstancesPerNode": 8},
    "GradientBoosting": {"maxIter": 50},
    "NeuralNetwork": {"hidden": (10, 10), "maxIter": 250},
    "Bagging": {"models": 10, "share": 0.2, "hidden": (10, 10), "maxIter": 100},
    "Boosting": {"models": 15, "share": 0.2, "hidden": (10, 10), "maxIter": 100},
    "AdaBoost": {"models": 400, "maxIter": 20},
}
#: Settings to search among, under Spark's names (leaves hold about half of what a split asks for; depth ends at 30).
SPACES = {
    "LinearRegression": {},
    "LogisticRegression": {"maxIter": [10, 20, 50, 100, 200, 500], "regParam": [0.0, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "SupportVectorMachine": {"degree": [1, 2, 3, 4, 5], "maxIter": [10, 20, 50, 100, 200, 500]},
    "DecisionTree": {"impurity": ["gini", "entropy"], "maxDepth": [5, 10, 15, 20], "minInstancesPerNode": [1, 3, 5, 8, 10]},
    "RandomForest": {"numTrees": [50, 100, 200, 500], "impurity": ["gini", "entropy"], "maxDepth": [5, 10, 20, 30], "minInstancesPerNode": [1, 3, 5, 10]},
    "NeuralNetwork": {"hidden": [(10, 10), (50, 50), (10, 50), (10, 10, 10), (50, 50, 50), (50, 10, 50), (10, 50, 10)], "maxIter": [50, 100, 500]},
    "AdaBoost": {"models": [400, 100]},
    "GradientBoosting": {},
    "Bagging": {},
    "Boosting": {},
}
#: Products of features that are made one by one; more are sketched in so many dimensions.
SKETCH = 2048
#: Models whose rows are weighted so that both classes count alike.
BALANCED = ("LogisticRegression", "SupportVectorMachine", "DecisionTree", "RandomForest")


@functools.lru_cache(maxsize=8)
def _count_sketches(width: int, degree: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([width, degree, dims])
    return rng.integers(0, dims, (degree, width + 1)), rng.choice([-1.0, 1.0], (degree, width + 1))


def tensor_sketch(x: np.ndarray, degree: int, dims: int = SKETCH) -> np.ndarray:
    """Rows whose products approximate the kernel (x y / width + 1) ** degree: count sketches, multiplied as spectra."""
    x = np.concatenate([x / np.sqrt(x.shape[1]), np.ones((len(x), 1))], axis=1)
    spectrum = None
    for place, sign in zip(*_count_sketches(x.shape[1] - 1, degree, dims), strict=True):
        one = np.zeros((len(x), dims))
        for i in range(x.shape[1]):
            one[:, place[i]] += sign[i] * x[:, i]
        own = np.fft.rfft(one, axis=1)
        spectrum = own if spectrum is None else spectrum * own
    return np.fft.irfft(spectrum, n=dims, axis=1)


def with_sketch(df: DataFrame, inputs: str, degree: int) -> DataFrame:
    """df with the sketched products of its input vector as __x."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sketch(rows: pd.Series) -> pd.Series:
        parts = [tensor_sketch(np.stack(rows[a : a + 1024]), degree) for a in range(0, len(rows), 1024)]
        return pd.Series([r for p in parts for r in p], dtype=object)

    return df.withColumn("__x", array_to_vector(sketch(vector_to_array(inputs))))


@dataclass
class Model:
    """Fitted parts and the weights of their scores; mean: scores are averaged, else summed and put through a logistic function."""

    kind: str
    features: list[str]
    parts: list[PipelineModel]
    alphas: list[float]
    mean: bool = True
    threshold: float = 0.5
    params: dict = field(default_factory=dict)

    def raw(self, df: DataFrame, part: PipelineModel, name: str) -> DataFrame:
        if self.params.get("sketched"):
            made = with_sketch(PipelineModel(part.stages[:-1]).transform(df), self.params["sketched"], self.params["degree"])
            out = part.stages[-1].transform(made)
        else:
            out = part.transform(df)
        if self.kind == "LinearRegression":
            value = F.col("prediction")
        elif self.kind == "SupportVectorMachine":
            value = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        else:
            value = vector_to_array("probability")[1]
        return out.withColumn(name, value).drop(*(c for c in out.columns if c not in df.columns))

    def boosted(self, df: DataFrame) -> DataFrame:
        """df with `score` of AdaBoost: its parts share all stages but the last, a linear one, so one product gives all their signs."""
        last = [part.stages[-1] for part in self.parts]
        weights, intercepts, alphas = np.array([m.coefficients.toArray() for m in last]).T, np.array([m.intercept for m in last]), np.array(self.alphas)

        @F.pandas_udf(T.DoubleType())
        def margin(rows: pd.Series) -> pd.Series:
            return pd.Series(np.sign(np.stack(rows) @ weights + intercepts) @ alphas if len(rows) else [], dtype=float)

        out = PipelineModel(self.parts[0].stages[:-1]).transform(df)
        out = out.withColumn("score", 1 / (1 + F.exp(-2 * margin(vector_to_array(last[0].getFeaturesCol())))))
        return out.select(*df.columns, "score")

    def score(self, df: DataFrame) -> DataFrame:
        if self.kind == "AdaBoost":
            return self.boosted(df).withColumn("predicted_match", F.when(F.col("score") < self.threshold, 0).otherwise(1))
        out = df
        for i, part in enumerate(self.parts):
            out = self.raw(out, part, f"__s{i}")
        parts = [F.col(f"__s{i}") * a for i, a in enumerate(self.alphas)]
        total = sum(parts[1:], parts[0])
        score = total / sum(self.alphas) if self.mean else 1 / (1 + F.exp(-2 * total))
        out = out.withColumn("score", score).drop(*(f"__s{i}" for i in range(len(self.parts))))
        return out.withColumn("predicted_match", F.when(F.col("score") < self.threshold, 0).otherwise(1))

    def importance(self) -> dict[str, float]:
        """Coefficients or importances by feature, of models of one part that have them."""
        last = self.parts[0].stages[-1]
        values = getattr(last, "featureImportances", None) or getattr(last, "coefficients", None)
        return dict(zip(self.features, map(float, values), strict=False)) if values is not None and len(self.parts) == 1 else {}

    def save(self, path: str, spark) -> None:
        for i, part in enumerate(self.parts):
            part.write().overwrite().save(f"{path}/part-{i}")
        about = {"kind": self.kind, "features": self.features, "alphas": self.alphas, "mean": self.mean, "threshold": self.threshold, "params": {k: v for k, v in self.params.items() if not callable(v)}}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(path: str, spark) -> Model:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        parts = [PipelineModel.load(f"{path}/part-{i}") for i in range(len(about["alphas"]))]
        return Model(about["kind"], about["features"], parts, about["alphas"], about["mean"], about["threshold"], about["params"])


def class_weights(df: DataFrame, label: str = "match", balanced: bool = True, factor: float = 10.0) -> DataFrame:
    """df with `weight`: n / (2 n_c), or factor * n0 / n1 for positives only."""
    n = {r[label]: r["count"] for r in evaluation.histogram(df, label).collect()}
    total, n0, n1 = sum(n.values()), n.get(0, 0), n.get(1, 0)
    w1 = total / (2 * max(n1, 1)) if balanced else factor * n0 / max(n1, 1)
    w0 = total / (2 * max(n0, 1)) if balanced else 1.0
    return df.withColumn("weight", F.when(F.col(label) == 1, w1).otherwise(w0))


def _stages(features: list[str], pca: int | None) -> tuple[list, str]:
    stages: list = [X.VectorAssembler(inputCols=features, outputCol="__v", handleInvalid="keep")]
    if pca:
        stages += [X.StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False), X.PCA(k=pca, inputCol="__c", outputCol="__p")]
    return stages, "__p" if pca else "__v"


def _estimator(kind: str, inputs: str, width: int, label: str, p: dict) -> list:
    common = {"featuresCol": inputs, "labelCol": label}
    pick = lambda *names: {n: p[n] for n in names if n in p}
    if kind == "LinearRegression":
        return [R.LinearRegression(**common)]
    if kind == "LogisticRegression":
        return [C.LogisticRegression(**common, weightCol="weight", **pick("maxIter", "regParam", "elasticNetParam"))]
    if kind == "SupportVectorMachine":
        return [X.PolynomialExpansion(inputCol=inputs, outputCol="__x", degree=p["degree"]), C.LinearSVC(featuresCol="__x", labelCol=label, weightCol="weight", **pick("maxIter", "regParam"))]
    if kind == "DecisionTree":
        return [C.DecisionTreeClassifier(**common, weightCol="weight", seed=p["seed"], **pick("impurity", "maxDepth", "minInstancesPerNode"))]
    if kind == "RandomForest":
        return [C.RandomForestClassifier(**common, weightCol="weight", seed=p["seed"], **pick("impurity", "maxDepth", "numTrees", "minInstancesPerNode"))]
    if kind == "GradientBoosting":
        return [C.GBTClassifier(**common, seed=p["seed"], **pick("maxIter", "maxDepth"))]
    if kind in ("NeuralNetwork", "Bagging", "Boosting"):
        return [C.MultilayerPerceptronClassifier(**common, layers=[width, *p["hidden"], 2], seed=p["seed"], **pick("maxIter"))]
    raise ValueError(f"no such model: {kind}")


def fit(df: DataFrame, kind: str, features: list[str], label: str = "match", pca: int | None = None, threshold: float = 0.5, seed: int = 1, **params) -> Model:
    """A model of the given kind; pca: centred principal components in place of the features; seed: of what is drawn."""
    p = DEFAULTS[kind] | {"seed": seed} | params
    stages, inputs = _stages(features, pca)
    width = pca or len(features)
    df = df.withColumn("__label", F.col(label).cast("double"))

    def pipeline(what: str, data: DataFrame) -> PipelineModel:
        return Pipeline(stages=[*stages, *_estimator(what, inputs, width, "__label", p)]).fit(data)

    if kind == "AdaBoost":
        return _adaboost(df, stages, inputs, features, p, threshold)
    if kind in ("Bagging", "Boosting"):
        model = Model(kind, features, [], [], True, threshold, p)
        # the sum of the parts' scores is carried in a written column, so that a round scores its own part only
        rows = writers.materialise(df.withColumn("__total", F.lit(0.0)), "boosting")
        for i in range(p["models"]):
            weight = F.lit(1.0)
            if kind == "Boosting" and i:  # rows that the mean score has wrong come more often
                mean = F.col("__total") / i
                weight = F.least(1 / F.greatest(F.when(F.col(label) == 1, mean).otherwise(1 - mean), F.lit(1e-6)), F.lit(10.0))
            drawn = weighted_sample(rows, weight, p["share"], seed=100 * p["seed"] + i)
            model.parts.append(pipeline(kind, drawn.drop("__total")))
            model.alphas.append(1.0)
            if kind == "Boosting" and i < p["models"] - 1:
                old, rows = rows, writers.materialise(model.raw(rows, model.parts[-1], "__own").withColumn("__total", F.col("__total") + F.col("__own")).drop("__own"), "boosting")
                writers.discard(old)
        writers.discard(rows)
        return model
    data = class_weights(df, label) if kind in BALANCED else df
    if kind == "SupportVectorMachine" and math.comb(width + p["degree"], p["degree"]) - 1 > SKETCH:
        ahead = Pipeline(stages=stages).fit(data)
        made = writers.materialise(with_sketch(ahead.transform(data), inputs, p["degree"]).select("__x", "__label", "weight"), "sketched")
        last = C.LinearSVC(featuresCol="__x", labelCol="__label", weightCol="weight", maxIter=p["maxIter"], regParam=p["regParam"]).fit(made)
        writers.discard(made)
        return Model(kind, features, [PipelineModel([*ahead.stages, last])], [1.0], True, threshold, p | {"sketched": inputs})
    return Model(kind, features, [pipeline(kind, data)], [1.0], True, threshold, p)


def _adaboost(df: DataFrame, stages: list, inputs: str, features: list[str], p: dict, threshold: float) -> Model:
    """SAMME for two classes, as many rounds as `models` unless a part has no error or no better one than chance.

    Each row's weight (1 on average) is carried in a written column, so that a round reads short rows whatever came
    before it; only the last round's rows are kept.
    """
    model = Model("AdaBoost", features, [], [], False, threshold, p)
    ahead = Pipeline(stages=stages).fit(df)
    learner = C.LogisticRegression(featuresCol=inputs, labelCol="__label", weightCol="weight", maxIter=p["maxIter"])
    hit = F.signum(vector_to_array("probability")[1] - 0.5) * (2 * F.col("__label") - 1)
    rows = writers.materialise(ahead.transform(df).select(inputs, "__label", F.lit(1.0).alias("weight")), "boosting")
    try:
        for i in range(p["models"]):
            fitted = learner.fit(rows)
            part = PipelineModel([*ahead.stages, fitted])
            tried = fitted.transform(rows).select(inputs, "__label", "weight", hit.alias("__hit"))
            at = tried.agg((F.sum(F.when(F.col("__hit") <= 0, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("e")).first()["e"]
            if at is None or at >= 0.5:
                break
            alpha = 0.5 * math.log((1 - max(at, 1e-6)) / max(at, 1e-6))
            model.parts.append(part)
            model.alphas.append(alpha)
            if at < 1e-6:
                break
            if i < p["models"] - 1:
                mean = at * math.exp(alpha) + (1 - at) * math.exp(-alpha)
                old, rows = rows, writers.materialise(tried.select(inputs, "__label", (F.col("weight") * F.exp(-alpha * F.col("__hit")) / mean).alias("weight")), "boosting")
                writers.discard(old)
    finally:
        writers.discard(rows)
    if not model.parts:
        model.parts, model.alphas = [part], [1.0]
    return model


def valid(kind: str, params: dict) -> bool:
    """Settings that belong together."""
    if params.get("elasticNetParam") and params.get("solver", "auto") == "normal":
        return False
    return not (kind == "DecisionTree" and params.get("maxDepth", 1) > 30)


def settings(space: dict[str, list], search: str = "grid", draws: int = 5, seed: int = 1) -> list[dict]:
    """All combinations, or some random ones."""
    if search == "none" or not space:
        return [{}]
    names = sorted(space)
    if search == "random":
        rng = random.Random(seed)
        return [{n: rng.choice(space[n]) for n in names} for _ in range(draws)]
    return [dict(zip(names, v, strict=True)) for v in itertools.product(*(space[n] for n in names))]


@dataclass
class Trained:
    model: Model
    train: dict
    test: dict
    setting: dict = field(default_factory=dict)


def train(df: DataFrame, kind: str, features: list[str], label: str = "match", config: Config = Config(), criterion: str = "max_precision", space: dict | None = None, search: str = "none", key: str = "pair_id", run: int = 0, **params) -> list[Trained]:
    """Every valid setting fitted on four fifths of the pairs, its threshold chosen from quantiles of the training scores by the test pairs.

    space: settings to search among, those of the kind if none are given. run: each run has a split and a seed of its own.
    """
    learn, test = hash_split(df, key, 0.8, seed=42 + run)
    out = []
    for setting in settings(SPACES[kind] if space is None else space, search):
        if not valid(kind, setting):
            continue
        model = fit(learn, kind, features, label, seed=1 + run, **(params | setting))
        limits = evaluation.thresholds(model.score(learn), "score", config.thresholds)
        rows = evaluation.sweep(model.score(test), limits, label).collect()
        best = evaluation.best_threshold(rows, criterion, config)
        if best is None:
            continue
        model.threshold = best["threshold"]
        own = {k: v for k, v in evaluation.metrics(model.score(learn), label).first().asDict().items()}
        out.append(Trained(model, own, best, setting))
    return out


def best_of(trained: list[Trained], primary: str = "precision", secondary: str = "recall", able: Callable[[dict], bool] = lambda r: True) -> Trained:
    """The model of best primary value, then of best secondary one; the first of equals."""
    able_ones = [t for t in trained if able(t.test)]
    if not able_ones:
        raise ValueError("no model meets the minimum")
    return max(able_ones, key=lambda t: (t.test[primary], t.test[secondary]))


def averaged(trained: list[list[Trained]]) -> list[tuple[dict, dict, dict]]:
    """Setting, training and test statistics, averaged over several runs of one search."""
    by_setting: dict[str, list[Trained]] = {}
    for t in itertools.chain.from_iterable(trained):
        by_setting.setdefault(json.dumps(t.setting, sort_keys=True), []).append(t)
    return [(own[0].setting, evaluation.mean_statistics([t.train for t in own]), evaluation.mean_statistics([t.test for t in own])) for own in by_setting.values()]


def results(spark, trained: list[Trained]) -> DataFrame:
    """A row a setting with its training and test statistics, the best test F1 first."""
    names = ("f1", "accuracy", "precision", "recall")
    rows = [(json.dumps(t.setting, sort_keys=True), *(float(own[n]) for own in (t.train, t.test) for n in names)) for t in trained]
    return spark.createDataFrame(rows, "setting string, " + ", ".join(f"{part}_{n} double" for part in ("train", "test") for n in names)).orderBy(F.desc("test_f1"), "setting")
