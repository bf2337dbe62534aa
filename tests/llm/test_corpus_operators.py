"""Each operator against brute force, a round trip or held-out rows, and on odd rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import ann, decontaminate, html_extract, language_id, license_scan, ngram_join, packing, quality, token_output, tokens, toxicity
from pairloom.llm.queries import tokenizer_file

ODD = [(1, "the mit license", "x"), (1, "the mit license", "x"), (2, None, "x"), (3, "", "x"), (4, "  \n ", "x"), (None, "no id here", "x"), (5, "word " * 30_000, "x"), (6, "é½² \x00 it's  a\n\n b ", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame(ODD, "doc_id long, text string, score string").withColumn("node", F.lit(1)).withColumn("tile", F.lit(2)).repartition(2)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def words(rng, n, size=400):
    return " ".join(f"w{rng.integers(size)}" for _ in range(n))


# Benchmark decontamination


def test_decontamination_is_brute_force(spark):
    rng = np.random.default_rng(1)
    items = [(i, words(rng, int(rng.integers(8, 40)))) for i in range(12)] + [(90, "two words"), (91, None), (92, "")]
    docs = []
    for d in range(60):
        text = words(rng, int(rng.integers(0, 120))).split()
        if d % 2:
            own = items[int(rng.integers(12))][1].split()
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(len(own)))] = "changed"
            at = int(rng.integers(len(text) + 1))
            text[at:at] = own
        docs.append((d, " ".join(text) + (" two, words!" if d % 7 == 0 else "")))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start_word"]) for r in got.collect()}
    want = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        own, it = text.replace(",", "").replace("!", "").split(), (item or "").split()
        k = min(5, len(it))
        grams = lambda w, k=k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if k else []
        a, b = grams(it), grams(own)
        for s in range(max(1, len(b) - len(a) + 1)) if a and b else ():
            w = b[s : s + len(a)]
            both = sum(min(a.count(g), w.count(g)) for g in set(a))
            sim = both / (len(a) + len(w) - both)
            if sim >= 0.8 - 1e-12 and sim > want.get((d, i), (0,))[0] + 1e-12:
                want[d, i] = (sim, s)
    assert len(want) > 10
    assert got == {k: (round(s, 9), at) for k, (s, at) in want.items()}


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "the mit license"), (1, "the mit license"), (2, None)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(odd, items).collect()] == [1, 1]
    assert decontaminate.contaminated(empty, items).count() == decontaminate.contaminated(odd, items.where("false")).count() == 0
    kept = decontaminate.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2


# Packing


def test_packing_keeps_every_token(spark, odd, empty):
    rows = packing.pack_documents(odd, tokenizer_file(), capacities=(16, 64), block=50).toPandas()
    for _, b in rows.groupby("bin_id"):
        spans = sorted(zip(b.bin_offset, b.bin_offset + b.n_tokens, strict=True))
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(spans)) and spans[-1][1] <= b.capacity.iloc[0]
        assert b.capacity.iloc[0] == 16 or b.n_tokens.sum() > 16
    encode = tokens.encoder(tokenizer_file()).tokenizer
    want = sum(len(encode.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ODD)
    assert rows.n_tokens.sum() == want
    assert packing.pack_documents(empty, tokenizer_file()).count() == 0


def test_packing_chooses_the_cheaper_lengths():
    _, _, final = packing.pack([10] * 6, (20, 60), quadratic=1e9)
    assert sum(final) == 60
    _, _, final = packing.pack([10] * 6, (20, 60), quadratic=10.0)
    assert final == [20, 20, 20]
    assert packing.pack([]) == ([], [], [])


# HTML


def test_html_layouts():
    field = html_extract.trained()
    pages = html_extract.labelled_pages(150, seed=77)
    wrong = sum(html_extract.extract(html, field) != main for html, main in pages)
    assert wrong <= 12
    page = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>First   line<br>of text, here.<p>Second block, of text.</article><footer>&copy; us</footer>"
    assert html_extract.extract(page, field) == ["A & B", "First line of text, here.", "Second block, of text."]


def test_html_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (3, "<p", "n"), (4, "<script>x</script>", "n"), (4, "<script>x</script>", "n")], "page_id long, html string, text string")
    got = html_extract.main_texts(pages, ["page_id"]).collect()
    assert len(got) == 5 and all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] != 3)
    assert html_extract.main_texts(pages.where("false"), ["page_id"]).count() == 0


# Token files


def test_special_tokens_are_the_tokenizer_files_own(spark, tmp_path):
    import corpus_pipeline
    from pairloom.llm import queries
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_file())
    special = next(t.content for t in fresh.get_added_tokens_decoder().values() if t.special)
    texts = [f"a {special} b", f"{special}{special}c  d", f"no such token {special[:-1]} here", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] != tokens.encoder(tokenizer_file()).tokenizer.encode(texts[0], add_special_tokens=False).ids
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries.op4_token_output(spark, str(tmp_path)).collect()}
    assert got == {i: (len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, ids in enumerate(want)}
    for rows in (queries.op2_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        assert {r["doc_id"]: r["n_tokens"] for r in rows.collect()} == {i: len(ids) + 1 for i, ids in enumerate(want)}


def test_encoder_equals_the_library():
    e = tokens.encoder(tokenizer_file())
    texts = ["", " ", "  a", "a  b\n c", "a\n\n b é½² \x00 it's I'll x'", "日本 語 12 34.5", "\n", "x\n", "\nx y\nz", "x \ny", "a\tb\nc", "x,\n(y)\n", "a\r\nb", "tail ", "tail \n", "<|endoftext|> x", "Ünï çödé*** %%%word!! |"]
    flat, at = e.encode(texts)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert e.lengths(texts).tolist() == np.diff(at).tolist()


def test_token_files_round_trip(spark, odd, empty, tmp_path):
    path = str(tmp_path / "t")
    token_output.write_token_files(odd, path, tokenizer_file())
    got = token_output.token_index(spark, path).orderBy("start").collect()
    e, at = tokens.encoder(tokenizer_file()).tokenizer, 0
    assert [r["doc_id"] for r in got] == sorted((d for d, *_ in ODD), key=lambda d: (d is not None, d or 0))
    for r in got:
        text = next(t for d, t, _ in ODD if d == r["doc_id"]) or ""
        ids = np.array([*e.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"] for r in token_output.read_token_files(spark, path, [1, 5]).collect()} == {1, 5}
    token_output.write_token_files(empty, str(tmp_path / "e"), tokenizer_file())
    assert token_output.token_index(spark, str(tmp_path / "e")).count() == 0


# Nearest neighbours


def test_ann_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24)) + 2 * rng.standard_normal((8, 24))[rng.integers(8, size=3000)]
    x[100:160] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0]), (None, [1.0] * 24), (5200, [None] * 24)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    mine: dict = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        mine.setdefault(r["query_id"], []).append(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        hits += len(set(np.lexsort((np.arange(3000), -s))[:5]) & set(mine[q]))
    assert len(mine) == 60 and hits >= 0.9 * 300
    assert mine[50] == [100, 101, 102, 103, 104]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.nearest(none, F.col("vec_id") % 50 == 0).count() == 0


# Classifiers of texts


def test_toxicity_finds_sentences(spark, odd, empty):
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for i in range(400):
        s = [words(rng, 8) + "." for _ in range(10)]
        if i % 4 == 0:
            s[3] = f"w1 {['vileman', 'vilething', 'nasty'][i % 3]} w2."
        texts.append(" ".join(s))
        labels.append(int(i % 4 == 0))
    model = toxicity.NoisyOr().fit(texts[:300], labels[:300])
    score = np.array(model.scorer()(texts[300:])[0])
    assert ((score >= 0.5) == np.array(labels[300:], bool)).all()
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["number"]) for r in toxicity.offending_sentences(docs, model).collect()] == [(1, 3)]
    rows = toxicity.score_documents(odd, model, ["doc_id"]).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] < 0.5 for r in rows)
    assert toxicity.score_documents(empty, toxicity.NoisyOr().fit([], []), ["doc_id"]).count() == 0


def test_language_profiles(odd, empty):
    rng = np.random.default_rng(4)
    make = lambda letters: "".join(rng.choice(list(letters), 300))
    texts, langs = zip(*[(make("abcde   "), "xx") if i % 2 else (make("aeiou éè  "), "yy") for i in range(120)], strict=True)
    model = language_id.Profiles().fit(list(texts[:60]), list(langs[:60]))
    assert model.predict(list(texts[60:]))[0] == list(langs[60:])
    assert model.predict(["", "12 !"]) == (["und", "und"], [0.0, 0.0])
    assert language_id.Profiles().predict(["a"]) == (["und"], [0.0])
    assert language_id.identify(odd, model, ["doc_id"]).count() == len(ODD)
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns
    assert language_id.identify(empty, model, ["doc_id"]).count() == 0


def test_quality_model(odd, empty):
    rng = np.random.default_rng(5)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel().fit(x[:1000], y[:1000], pair_rounds=40)
    assert (0, 1) in model.pairs
    assert ((model.score(x[1000:]) > 0.5) == (y[1000:] > 0)).mean() > 0.9
    texts = quality.AdditiveModel().fit(quality.feature_rows(["a b c.", "!!! $$$"] * 50), np.array([1.0, 0.0] * 50))
    assert quality.score_documents(odd, texts, ["doc_id"]).count() == len(ODD)
    assert quality.keep_good(odd, texts).columns == odd.columns
    assert quality.score_documents(empty, quality.AdditiveModel().fit(np.empty((0, 22)), np.empty(0)), ["doc_id"]).count() == 0


# Licences


def test_license_places(odd, empty):
    scan = license_scan.scan_text
    assert scan("") == (0, 0, None, None, "", "", 0.0, [])
    assert scan("Under the MIT-License; MIT license. xmit license")[:6] == (8, 2, 2, 4, "mit", "mit")
    assert scan("Released under GNU General Public License, version 3")[4:6] == ("gpl", "gpl,gpl-3.0")
    assert [p["label"] for p in scan("GNU Lesser General Public License v2.1")[7]] == ["lgpl-2.1"]
    assert scan("Licensed under CC BY-NC 4.0.")[5] == "cc-by-nc-4.0"
    for line in license_scan.RULES.strip().splitlines():
        assert len(line.split(" ", 3)) == 4
    assert len(license_scan.RULES.strip().splitlines()) > 200
    assert license_scan.scan(odd, ["doc_id"]).where("n_base = 1").count() == 2
    assert license_scan.scan(empty, ["doc_id"]).count() == 0


# N-gram join


def brute_classes(rows):
    grams = {}
    for d, t in rows:
        w = (t or "").lower().split()
        grams[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in grams}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    links = dict.fromkeys(grams, 0)
    for a, b in itertools.combinations(sorted(grams), 2):
        if grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in grams}


def test_join_is_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for group in range(25):
        base = words(rng, int(rng.integers(3, 90)), 5000).split()
        for _ in range(1 if group % 3 else 12):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(len(own)))] = f"v{rng.integers(9000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    for block in (192, 4):  # whole buckets, and hot ones cut into blocks
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.jaccard_classes(docs, block=block).collect()}
        assert got == want
    kept = {r["doc_id"] for r in ngram_join.keep_one_of_each(docs).collect()}
    assert kept == {c for c, _ in want.values()}


def test_join_odd_rows(spark, odd, empty):
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.jaccard_classes(odd).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0), (None, None, 0), (5, 5, 0), (6, 6, 0)], key=str)
    kept = ngram_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert ngram_join.jaccard_classes(empty).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.9999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


# The pipeline


def test_pipeline_keeps_the_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_copies", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out.doc_id) <= {r["doc_id"] for r in docs.select("doc_id").collect()} and len(out)
    clean = corpus_pipeline.STAGES[3][1](spark, docs, sf)
    hits = decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).select("doc_id").distinct().count()
    assert clean.columns == docs.columns and clean.count() == docs.count() - hits
