import pytest
from pyspark.sql import functions as F

from pairloom.functions import cleansing, keywords, python_udfs, similarity, text
from pairloom.functions.vocab import clean_vocabulary


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*items):
    return F.array(*map(F.lit, items)).cast("array<string>")


@pytest.mark.parametrize(("given", "want"), [("1,000 pcs", "1000 pcs"), ('14" tv', "14 inch tv"), ("2x3", "2×3"), ("5 - 6 (a)", "5-6 a")])
def test_clean_text(spark, given, want):
    assert value(spark, text.clean_text(F.lit(given), decompose=False)) == want


def test_tokens_and_units(spark):
    assert value(spark, text.tokenize(F.lit("1.25kb 12.5kb 50% 5% wh-1000xm4"))) == ["1.25kb", "12", "5kb", "50", "5%", "wh", "1000xm4"]
    assert value(spark, text.split_units(arr("1.25kb", "5%"))) == ["1.25", "kb", "5", "%"]


def test_specification(spark):
    raw = F.lit('[{"key":"a\\n","value":1},{"key":"a","value":"2\\t"},{"key":"b","value":"3"}]')
    assert [tuple(r) for r in value(spark, text.parse_specification(raw))] == [("a", "2"), ("b", "3")]
    assert value(spark, text.specification_text(text.parse_specification(raw))) == "a 2 b 3 "
    assert value(spark, text.codes(F.lit('["a" , "b"]'))) == ["a", "b"]
    assert value(spark, text.codes(F.lit(""))) == [""]


def test_keyword_tags(spark):
    v = clean_vocabulary(brands=["Acme"])
    tag = lambda *t: value(spark, keywords.tag_tokens(arr(*t), v))
    assert tag("1234") == ["#id#1234"]
    assert tag("123") == ["#num#123"]
    assert tag("5", "kg") == ["5000.0", "#unit#g"]
    assert tag("14", "inch") == ["0.3556", "#unit#m"] or tag("14", "inch")[1] == "#unit#m"
    assert tag("red", "acme", "word") == ["#col#red", "#bnd#acme", "word"]
    assert tag() == [""]


def test_python_floats(spark):
    for x, want in ((10.0, "10.0"), (1e16, "1e+16"), (0.5, "0.5"), (1e-5, "1e-05"), (1500.25, "1500.25")):
        assert value(spark, keywords.python_float(F.lit(x))) == want


def test_ratios(spark):
    assert value(spark, similarity.words_ratio(arr("a", "b"), arr("b", "c"))) == 0
    assert value(spark, similarity.words_ratio(arr("a"), arr("a"))) == 1
    assert value(spark, similarity.words_ratio(arr("a"), arr("b"))) == -1
    assert value(spark, similarity.words_ratio(arr(), arr())) == 0
    assert value(spark, similarity.id_ratio(arr("#id#1234"), arr("#id#12345"))) == 1
    assert value(spark, similarity.numbers_distance(arr("#num#1", "#num#2"), arr("#num#2", "#num#3"))) == 0.5
    assert value(spark, similarity.code_ratio(arr("x", "y"), arr("y"))) == 0.5
    assert value(spark, similarity.code_ratio(arr("x"), arr("y"))) == -1


def test_units(spark):
    a, b = arr("2.0", "#unit#m"), arr("2.05", "#unit#m")
    assert value(spark, similarity.units_distance(a, b)) == 0
    assert value(spark, similarity.units_distance(arr("2.0", "#unit#m", "1.0", "#unit#g"), b)) == pytest.approx(1 / 3)


def test_hashes(spark):
    a, b, c = "ffff0000ffff0000", "ffff0000ffff000f", "ffff0000ffff00ff"
    assert value(spark, similarity.nibble_similarity(F.lit(a), F.lit(b))) == 0.9375
    assert value(spark, similarity.hash_similarity(arr(a), arr(b))) == 0
    assert value(spark, similarity.hash_similarity(arr(a), arr(c))) == 0.875
    assert value(spark, similarity.bit_similarity(F.lit(a), F.lit(b))) == 1 - 4 / 64


def test_prices_and_matches(spark):
    assert [python_udfs.parse_price(t) for t in ("SAR 1,299.00", "1.299,50", "12", "none", "1,299")] == [1299.0, 1299.5, 12.0, None, 1299.0]
    ok = lambda n1, n2, i1, i2, b: value(spark, cleansing.same_model(*(F.lit(x) for x in (n1, n2, i1, i2, b))))
    assert ok("a", "b", "AB123", "AB199", "x")
    assert not ok("a", "b", "AB1234", "AB5678", "x")
    assert not ok("iphone 13 max 128gb", "iphone 13 128gb", None, None, "apple")
    assert ok("a", "b", "A", "B", "x")
    assert value(spark, cleansing.discount_amount(F.lit(80.0), F.lit(100.0))) == 20
    assert value(spark, cleansing.discount_amount(F.lit(80.0), F.lit(0.0))) == 0


def test_stems():
    want = {"running": "run", "flies": "fli", "happily": "happili", "national": "nation", "hopping": "hop", "sky": "sky", "generously": "generous", "cats": "cat"}
    assert {w: python_udfs.stem(w) for w in want} == want
