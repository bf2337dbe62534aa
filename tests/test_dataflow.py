"""The matching dataflow end to end, and the functions that no query runs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.config import Config
from pairloom.functions import cleansing, images
from pairloom.functions.vocab import clean_vocabulary
from pairloom.ml import classifiers
from pairloom.operators import evaluation, features, relational
from pairloom.plans import matching
from pairloom.schema import feature_columns

SHOPS = 24


@pytest.fixture(scope="module")
def shops(spark):
    """Two shops that sell the same things under names that differ a little."""
    kinds = ["kettle", "lamp", "chair", "table"]
    rows = lambda end, more: [(f"{end}{i}", f"{kinds[i % 4]} model{i} AB{1000 + i} café{i % 3}", "", f"{kinds[i % 4]} {i + 2} cm {more}", 100.0 + i, f"http://{end}/{i}", [f"AB{1000 + i}"]) for i in range(SHOPS)]
    schema = "id string, name string, short_description string, long_description string, price double, url string, code array<string>"
    made = [spark.createDataFrame(rows(e, m), schema).withColumn("specification", F.array(F.struct(F.lit("size").alias("key"), F.concat(F.col("price").cast("int").cast("string"), F.lit(" cm")).alias("value")))) for e, m in (("a", "steel"), ("b", "made of steel"))]
    return [matching.as_products(d) for d in made]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(f"a{i}", f"b{(i + k) % SHOPS}", int(k == 0)) for i in range(SHOPS) for k in (0, 1, 4, 8)], "id1 string, id2 string, match int")


def test_match_from_training_to_export(spark, shops, labelled):
    trained = matching.train_matcher(labelled, *shops, clean_vocabulary(), ["LogisticRegression"], Config(thresholds=10), criterion="max_f1", runs=2)
    assert trained.test["f1"] > 0.8
    found = matching.match(labelled, *shops, trained.model, clean_vocabulary())
    metrics, missed = matching.evaluate_matches(found, labelled)
    assert metrics.first()["f1"] > 0.8 and set(missed.columns) == {"id1", "id2", "predicted_match", "match"}
    cache = found.select("all_texts_hash1", "all_texts_hash2", F.lit(0.25).alias("predicted_scores"))
    again = matching.match(labelled, *shops, trained.model, clean_vocabulary(), cache=cache)
    assert {r["predicted_scores"] for r in again.collect()} == {0.25} and again.count() == found.count()


def test_feature_frame(spark, shops, labelled):
    a, b = (features.tokenised(s, clean_vocabulary()) for s in shops)
    hashes = [spark.createDataFrame([("a0", "0" * 16), ("a0", "f" * 16)], "id string, hash string"), spark.createDataFrame([("b0", "0" * 8 + "1" * 8)], "id string, hash string")]
    frame = features.features(labelled, a, b, images=tuple(hashes)).toPandas().set_index(["id1", "id2"])
    assert list(frame.columns) == ["all_texts_hash1", "all_texts_hash2", "birthdate", *feature_columns(), "hash_similarity"]
    assert frame.loc[("a0", "b0"), "hash_similarity"] == 0.5 and frame.loc[("a1", "b1"), "hash_similarity"] == 0
    assert frame.loc[("a3", "b3"), "code"] > frame.loc[("a3", "b4"), "code"]
    assert frame.loc[("a3", "b3"), "name_cos"] > frame.loc[("a3", "b4"), "name_cos"]
    assert (frame.specification_key_matches == 1).all() and frame.loc[("a3", "b3"), "specification_key_value_matches"] == 1
    names = a.where("id = 'a1'").select("name_plain").first()[0]
    assert names[0] == "lamp" and all(t.isascii() for t in names[:3])  # the accent is a letter and a mark of its own
    marked, plain = features.split_marked(a)
    assert "name_plain" not in marked.columns and plain.where("id = 'a1'").select("name").first()[0] == names


def test_languages_and_switches(spark, shops):
    products = shops[0].withColumn("name", F.lit("running KETTLES 12345678"))
    name = lambda **how: features.tokenised(products, clean_vocabulary(), **how).select("name").first()[0]
    assert name(config=Config(language="english"))[:2] == ["run", "kettl"]
    words = F.create_map(F.lit("kettles"), F.lit("kettle"))
    assert name(config=Config(language="czech"), dictionary=words)[1] == "kettle"
    with pytest.raises(ValueError):
        name(config=Config(language="czech"))
    upper = Config(lower_case=False)
    assert "#id#12345678" in name(config=upper)
    assert "#id#12345678" not in name(config=upper, known_words=F.array(F.lit("12345678")))
    assert "#id#12345678" not in name(config=Config(lower_case=False, undetected={"name": ("words",)}))


def test_aggregate_matches(spark):
    source = spark.createDataFrame([("u1", "S1")], "url string, SKU string")
    other = spark.createDataFrame([("v1", None, 80.0, 100.0, True, {"kind": "gift"}, [], "")], "url string, SKU string, netPrice double, originalPrice double, bundle boolean, freeItem map<string,string>, couponDiscount array<string>, bankPromo string")
    matches = spark.createDataFrame([("u1", "v1", "1", "1", "lamp", "lamp", "x")] * 2, "url1 string, url2 string, id1 string, id2 string, name1 string, name2 string, brand string")
    rows = matching.aggregate_matches(matches, source, other, "C", "shop").collect()
    assert [(r["CSKUID"], r["discountAmount"], r["discountType"], r["discountName"]) for r in rows] == [("S1", 20.0, '"bundle","freeItem"', '"true","{"kind":"gift"}"')]


def test_discount_values(spark):
    row = spark.createDataFrame([(0, 0.0, "", False, [], None)], "a int, b double, c string, d boolean, e array<int>, f struct<x:int>")
    made = row.select(*(cleansing.discount_value(F.col(c), k).alias(c) for c, k in row.dtypes)).first()
    assert all(v is None for v in made)


def test_search_results_and_means(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y), int(x + y > 1)) for i, (x, y) in enumerate(rng.random((240, 2)))]
    df = spark.createDataFrame(rows, "pair_id long, x double, y double, match int")
    runs = [classifiers.train(df, "DecisionTree", ["x", "y"], criterion="max_f1", space={"maxDepth": [1, 5]}, search="grid", run=r, config=Config(thresholds=10)) for r in range(2)]
    assert [len(r) for r in runs] == [2, 2] and runs[0][0].test != runs[1][0].test
    table = classifiers.results(spark, runs[0]).toPandas()
    assert list(table.test_f1) == sorted(table.test_f1, reverse=True) and "maxDepth" in table.setting[0]
    means = classifiers.averaged(runs)
    assert len(means) == 2 and means[0][2]["f1"] == pytest.approx((runs[0][0].test["f1"] + runs[1][0].test["f1"]) / 2)
    assert classifiers.settings(classifiers.SPACES["SupportVectorMachine"], "random", 5) and classifiers.best_of(runs[0]).test["precision"] == max(t.test["precision"] for t in runs[0])
    assert evaluation.mean_statistics([]) == {}


def test_sketched_products(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 20)) / 4
    made, exact = classifiers.tensor_sketch(x, 3, 8192), (x @ x.T / 20 + 1) ** 3
    assert np.abs(made @ made.T - exact).max() < 0.2
    rows = [(*map(float, r), int(r[0] * r[1] > 0)) for r in rng.standard_normal((400, 12))]
    names = [f"x{i}" for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", match int")
    model = classifiers.fit(df, "SupportVectorMachine", names, degree=5, regParam=1e-4)
    assert model.params["sketched"] and evaluation.metrics(model.score(df)).first()["accuracy"] > 0.8
    model.save(str(tmp_path / "m"), spark)
    again = classifiers.Model.load(str(tmp_path / "m"), spark)
    assert [r["score"] for r in again.score(df.limit(5)).collect()] == pytest.approx([r["score"] for r in model.score(df.limit(5)).collect()])


def test_sides_and_chunks(spark):
    pairs = spark.createDataFrame([("a", "b", 1)], "id1 string, id2 string, match int")
    assert relational.side_of(pairs, 2, ("match",)).first() == ("b", 1)
    rows = spark.range(23)
    for parts in (4, 23, 40):
        got = [r["chunk"] for r in relational.query_chunks(rows, "id", parts).orderBy("id").collect()]
        assert got == [int(c[0]) for c in rows.selectExpr(f"ntile({parts}) over (order by id) as c").collect()]


def test_images(spark):
    name = spark.range(1).select(images.image_name("dataset1", F.lit("Ab 1/2"), F.lit(0))).first()[0]
    assert name == f"dataset1_{hashlib.sha224(b'ab-1-2-image-0').hexdigest()}.jpg"
    pixels = np.zeros((32, 24, 4), np.uint8)
    pixels[..., 3] = 255
    pixels[:, 12:, :3] = 200
    assert images.block_hash(pixels) == "0f" * 8
    odd = np.full((13, 9, 4), 255, np.uint8)
    assert images.block_values(odd).sum() == pytest.approx(13 * 9 * 765) and images.block_hash(odd) == "f" * 16
    got = spark.createDataFrame([(24, 32, bytearray(pixels.tobytes())), (24, 31, bytearray(pixels.tobytes())), (None, None, None)], "w int, h int, p binary").select(images.image_hash(F.col("w"), F.col("h"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["0f" * 8, None, None]
