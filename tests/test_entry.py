"""The driver's contract on the smallest tables, and the import without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from pairloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["part_matches", "price_window_or_missing", "tokenize_lower", "clean_numeric_text", "discount_columns", "tfidf_weights", "threshold_sweep", "chunk_ids", "cache_split_anti", "hamming_distance", "units_distance", "image_hash_similarity", "labelled_url_pairs", "spec_json_parse"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda x: round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), columns)


def made(plan):
    """Rows that each join of a finished plan gave."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return made(plan.executedPlan())
    if "QueryStage" in name:
        return made(plan.plan())
    own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in name else []
    return own + [n for i in range(plan.children().size()) for n in made(plan.children().apply(i))]


def part_matches_of(spark, tmp_path, *fill):
    con = duckdb.connect()
    con.execute(f"create table part as select p_partkey + 10000 * r as p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from '{SF}/part.parquet', range({fill[0]}) t(r)")
    for sql in fill[1:]:
        con.execute(sql)
    con.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    want = con.execute(catalog.SQL["part_matches"])
    df, columns = catalog.QUERIES["part_matches"](spark, str(tmp_path)), [c[0] for c in want.description]
    got = df.collect()
    assert plain(got, df.columns) == plain(want.fetchall(), columns)
    return df, len(got), con.execute("select count(*) from part").fetchone()[0]


def test_part_matches_joins_no_rows_to_rows(spark, tmp_path):
    df, found, parts = part_matches_of(spark, tmp_path, 30)
    assert max(made(df._jdf.queryExecution().executedPlan())) <= parts < found


def test_part_matches_on_odd_parts(spark, tmp_path):
    part_matches_of(spark, tmp_path, 1, """insert into part select 1000000 + row_number() over (), n, b, 'x', s, p from
        (values ('one two three four five'), ('five six seven eight nine'), ('Two tWo two'), (''), (null)) x(n), (values ('b'), (null)) y(b),
        (values (-15), (-5), (5), (null)) z(s), (values (0.0::double), (-3), (1), (2), ('inf'), ('nan'), (null)) w(p)""")


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_import_without_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for p in root.iterdir():
        if p.name in ("__spark_entry__.py",):
            (tmp_path / p.name).write_text(p.read_text())
    package = tmp_path / "pairloom"
    package.mkdir()
    for p in (root / "pairloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'part_matches' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, timeout=120)
