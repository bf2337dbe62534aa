import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.config import Config
from pairloom.functions.vocab import clean_vocabulary
from pairloom.ml import classifiers
from pairloom.operators import blocking, evaluation, relational, tfidf
from pairloom.plans import matching
from pairloom.sources import readers, writers
from pairloom.streaming.incremental import process_new


def test_price_window(spark):
    a = spark.createDataFrame([(1, 100.0), (2, 0.7)], "id1 int, price1 double")
    b = spark.createDataFrame([(1, 49.99), (2, 50.0), (3, 200.0), (4, 200.01), (5, 1.4), (6, None)], "id2 int, price2 double")
    got = {tuple(r) for r in blocking.price_window_join(a, b).select("id1", "id2").collect()}
    assert got == {(1, 2), (1, 3), (2, 5)}


def test_names_and_overlap(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "x", "y", "z"]), (["a", "b", "c"], ["a"] + list("nopqrstu"))], "n1 array<string>, n2 array<string>")
    assert [r[0] for r in rows.select(blocking.names_allow(F.col("n1"), F.col("n2"))).collect()] == [False, True]
    left = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "k1 int, t1 array<string>")
    right = spark.createDataFrame([(1, ["b", "a"]), (2, ["a"]), (3, ["z"])], "k2 int, t2 array<string>")
    for most in (None, 1, 5):
        got = {tuple(r) for r in blocking.token_overlap_pairs(left, right, "k1", "k2", "t1", "t2", most_rows=most).collect()}
        assert got == ({(1, 1, 2), (1, 2, 1)} if most != 1 else {(1, 1, 2)})


def test_rows_without_a_price_are_candidates(spark):
    names = [["a", "b", "c", "d"], ["a", "b"], ["b", "a", "x", "y", "z"], ["a", "p", "q", "r"], ["x"], []]
    prices = [100.0, 30.0, 0.0, None, float("nan")]
    rows = [(10 * i + j, p, n) for i, p in enumerate(prices) for j, n in enumerate(names)]
    left, right = (spark.createDataFrame(rows, f"id{k} int, price{k} double, name{k} array<string>") for k in (1, 2))
    priced = lambda p: p is not None and p > 0

    def may(p1, n1, p2, n2):
        shared = len(set(n1) & set(n2))
        window = not priced(p2) or priced(p1) and 0.5 * p1 <= p2 <= 2 * p1
        return window and shared >= 1 and (min(len(n1), len(n2)) < 4 or shared >= 2)

    want = sorted((a, b) for a, p1, n1 in rows for b, p2, n2 in rows if may(p1, n1, p2, n2))
    found = blocking.candidate_pairs(left, right)
    assert sorted(tuple(r) for r in found.select("id1", "id2").collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    free = blocking.shared_name_pairs(left, right.where("price2 = 0"), Config(name_overlap=0))
    assert free.where("id1 = 5").count() == len(names)


@pytest.mark.parametrize("block", [2, 4096])
def test_named_window_pairs_equal_all_pairs(spark, block):
    names = ["a b", "b a", "A b c d", "a x y z", "q", "", None]
    prices = [0.0, -1.0, 4.9e-324, 1.0, 2.0, 2.0000001, 4.0, 8.0, 16.0, 100.0, float("inf"), float("nan"), None]
    rows = [(i * 7919 % 1009, p, n, i % 2 or None) for i, (p, n) in enumerate((p, n) for p in prices for n in names for _ in range(3))]
    rows += rows[:9]  # repeated rows meet others as often as they stand there
    below = lambda x, y: y != y or x <= y  # noqa: E731  NaN is above all

    of = lambda r: r[2].lower().split(" ")

    def may(a, b):
        shared = len(set(of(a)) & set(of(b)))
        return below(0.5 * a[1], b[1]) and below(b[1], 2 * a[1]) and shared >= 1 and (min(len(of(a)), len(of(b))) < 4 or shared >= 2)

    whole = [r for r in rows if None not in r]
    want = sorted((a[0], b[0], len(of(a)) + len(of(b))) for a in whole for b in whole if a[0] < b[0] and may(a, b))
    frame = spark.createDataFrame(rows, "id long, price double, name string, k int")
    got = blocking.named_window_pairs(frame, ["k"], lambda n: F.split(F.lower(n), " "), lambda x, y: F.size(x) + F.size(y), block=block)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 400


def test_match_finds_targets_without_a_price(spark):
    product = lambda i, price: (i, "acme steel kettle large", price)
    left = matching.as_products(spark.createDataFrame([product("s", 10.0)], "id string, name string, price double"))
    right = matching.as_products(spark.createDataFrame([product("near", 11.0), product("far", 99.0), product("null", None), product("zero", 0.0)], "id string, name string, price double"))
    model = classifiers.Model("LinearRegression", [], [], [], threshold=0.5)
    model.score = lambda df: df.withColumn("score", F.lit(1.0))
    assert {r["id2"] for r in matching.match(None, left, right, model, clean_vocabulary()).collect()} == {"near", "null", "zero"}


def test_weights(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["b"]), (4, ["b"])], "k int, t array<string>")
    w = {(r["k"], r["term"]): r["w"] for r in tfidf.weights(docs, "k", "t").collect()}
    ratio = w[1, "a"] / w[1, "b"]
    assert ratio == pytest.approx(1.916290731874155)
    assert w[1, "a"] ** 2 + w[1, "b"] ** 2 == pytest.approx(1)


def test_cache_split_and_lookup(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "h1 string, h2 string")
    cache = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.7)], "h1 string, h2 string, predicted_scores double")
    hit, miss = relational.split_by_cache(pairs, cache, ["h1", "h2"])
    assert [tuple(r) for r in hit.collect()] == [("a", "b", 0.7)]
    assert [tuple(r) for r in miss.collect()] == [("c", "d")]
    t = spark.createDataFrame([("u", 1), ("v", 2)], "url string, n int")
    s = spark.createDataFrame([("u", 1, "old"), ("u", 2, "new")], "url string, o int, name string")
    found, lost = relational.lookup_join(t, s, "url", F.col("o"))
    assert [(r["n"], r["name"]) for r in found.collect()] == [(1, "new")]
    assert [r["n"] for r in lost.collect()] == [2]


def test_thresholds_and_metrics(spark):
    scores = spark.range(200).select(F.col("id").cast("double").alias("score"))
    assert sorted(r["threshold"] for r in evaluation.thresholds(scores, "score").collect()) == [float(x) for x in range(1, 198, 2)]
    rows = [(1, 1)] * 3 + [(0, 1)] + [(0, 0)] * 5 + [(1, 0)]
    m = evaluation.metrics(spark.createDataFrame(rows, "match int, predicted_match int")).first()
    assert (m["accuracy"], m["recall"], m["precision"], m["f1"]) == pytest.approx((0.8, 0.75, 0.75, 0.75))
    assert m["specificity"] == pytest.approx(5 / 6)
    best = evaluation.best_threshold([{"threshold": 1.0, "recall": 0.9, "precision": 0.5, "f1": 0.6}, {"threshold": 2.0, "recall": 0.5, "precision": 1.0, "f1": 0.7}])
    assert best["threshold"] == 1.0


def test_chunks(spark):
    got = relational.chunk_ids(spark.range(25).withColumnRenamed("id", "k"), "k", 10).collect()
    assert {(r["k"], r["chunk"]) for r in got} == {(k, k // 10) for k in range(25)}


@pytest.mark.parametrize("kind", ["LogisticRegression", "DecisionTree", "AdaBoost"])
def test_classifiers_separate(spark, kind):
    rows = spark.createDataFrame([(float(x), float(y), int(x > 5)) for x in range(11) for y in range(4)], "a double, b double, match int")
    model = classifiers.fit(rows, kind, ["a", "b"], **({"models": 2} if kind == "AdaBoost" else {}))
    assert evaluation.metrics(model.score(rows)).first()["f1"] == 1


def test_adaboost_makes_all_its_models(spark):
    x, names = np.random.default_rng(1).normal(size=(120, 6)), [f"x{i}" for i in range(6)]
    rows = spark.createDataFrame([(*r, int(r[0] + r[1] ** 3 - r[2] > 0)) for r in x.tolist()], ", ".join(f"{n} double" for n in names) + ", match int")
    model = classifiers.fit(rows, "AdaBoost", names, models=10, maxIter=1)
    assert len(model.parts) == len(model.alphas) == 10
    # each round's weights, computed anew from all parts before it
    data = rows.toPandas()
    x, sign, weight = data[names].to_numpy(), 2 * data["match"].to_numpy() - 1, np.ones(len(data))
    margin = np.zeros(len(data))
    for part, alpha in zip(model.parts, model.alphas, strict=True):
        said = np.sign(x @ part.stages[-1].coefficients.toArray() + part.stages[-1].intercept)
        error = weight[said != sign].sum() / weight.sum()
        assert alpha == pytest.approx(0.5 * np.log((1 - error) / error))
        margin += alpha * said
        weight = np.exp(-margin * sign)
    assert [r["score"] for r in model.score(rows).collect()] == pytest.approx(list(1 / (1 + np.exp(-2 * margin))))


@pytest.mark.parametrize("kind", ["DecisionTree", "RandomForest", "SupportVectorMachine"])
def test_classes_weigh_alike(spark, kind):
    # where a is 1, one row in four is a match: rare among all, but more than its share of the classes
    rows = spark.createDataFrame([(float(k >= 180), int(k >= 195)) for k in range(200)] * 2, "a double, match int")
    model = classifiers.fit(rows, kind, ["a"], **({"numTrees": 5} if kind == "RandomForest" else {}))
    assert {(r["a"], r["predicted_match"]) for r in model.score(rows).collect()} == {(0.0, 0), (1.0, 1)}


def test_defaults_are_the_references():
    assert classifiers.DEFAULTS["AdaBoost"]["models"] == 400
    assert [classifiers.DEFAULTS["SupportVectorMachine"][n] for n in ("degree", "maxIter")] == [5, 100]


def test_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(float(x), int(x > 5)) for x in range(20)], "a double, match int")
    model = classifiers.fit(rows, "LogisticRegression", ["a"])
    model.save(str(tmp_path / "m"), spark)
    again = classifiers.Model.load(str(tmp_path / "m"), spark)
    assert [r["score"] for r in again.score(rows).collect()] == [r["score"] for r in model.score(rows).collect()]


def test_normalise(spark):
    raw = spark.createDataFrame([("n", "<b>x</b>\n&amp;y", "SAR 1,299.00", {"k": "v"}, "", "c"), ("n", "<b>x</b>\n&amp;y", "SAR 1,299.00", {"k": "v"}, "", "c")], "title string, body string, cost string, specs map<string,string>, sku string, code string")
    out = matching.normalise(raw, {"name": "title", "short_description": "body", "price": "cost", "specification": "specs", "code": ["sku", "code"], "url": "none"})
    assert [r.asDict(recursive=True) for r in out.collect()] == [{"name": "n", "short_description": "x &y", "price": 1299.0, "specification": [{"key": "k", "value": "v"}], "code": ["c"]}]


def test_export_is_bounded(spark, tmp_path):
    rows = spark.range(1000).select("id", F.lit("x" * 90).alias("t"))
    writers.export_csv(rows.coalesce(1), str(tmp_path / "out"), 30_000)
    sizes = [p.stat().st_size for p in (tmp_path / "out").glob("*.csv")]
    assert len(sizes) == 4 and max(sizes) < 31_000


def test_state_and_images(spark, tmp_path):
    writers.put_state(spark, str(tmp_path), "run", {"a": 1})
    assert writers.get_state(spark, str(tmp_path), "run") == {"a": 1}
    assert writers.get_state(spark, str(tmp_path), "other", 5) == 5
    images = spark.createDataFrame([(f"i{k}", bytes([k])) for k in range(7)], "name string, content binary")
    writers.write_image_chunks(images, str(tmp_path / "img"), per_chunk=3)
    back = {(r["name"], bytes(r["content"])) for r in readers.read_image_chunks(spark, str(tmp_path / "img")).collect()}
    assert back == {(f"i{k}", bytes([k])) for k in range(7)}


def test_micro_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    double = lambda df: df.select((F.col("id") * 2).alias("x"))
    for part in (range(3), range(3, 5)):
        spark.createDataFrame([(i,) for i in part], "id long").coalesce(1).write.mode("append").parquet(src)
        q = process_new(spark, src, spark.read.parquet(src).schema, out, str(tmp_path / "cp"), double)
        q.awaitTermination(120)
    assert sorted(r["x"] for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8]


def test_catalog_names():
    from pairloom.plans import catalog

    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert clean_vocabulary().units["kg"] == (1000.0, "g")


def test_training_queries_do_the_whole_job(spark, monkeypatch):
    from pairloom.plans import catalog

    asked = {}

    def fit(rows, kind, names, **params):
        asked[kind, *params] = (names, params)
        return classifiers.Model("none", [], [], [])

    monkeypatch.setattr(classifiers, "fit", fit)
    monkeypatch.setattr(classifiers.Model, "score", lambda self, df: df.withColumn("predicted_match", F.col("match")))
    for name in catalog.QUERIES:
        if name.startswith("train_") and name != "train_test_split":
            catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {kind for kind, *_ in asked} == set(classifiers.DEFAULTS)
    for (kind, *more), (names, params) in asked.items():
        assert names == [f"x{i}" for i in range(64)] and params == ({"pca": 10} if more else {})
