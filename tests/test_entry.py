"""The driver's contract, and every catalogue query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ("text_similarity", "telemetry_totals", "hmac_verify", "python_ast_calls", "pdg_edges_udtf", "cross_file_taint", "graph_filter_numeric", "khop_neighborhood", "cycles_canonical", "slice_components", "coupling_instability", "schema_diff", "sink_scan", "duplicate_blocks", "session_windows", "near_line_band_join")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(row):
    return tuple("" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)


def test_entry(spark):
    assert entry.entry(spark).count() == 50


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80


@pytest.mark.parametrize("name", FAST)
def test_sql_twin(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(plain(r) for r in got.select(*columns).collect()) == sorted(plain(r) for r in want.select(*columns).fetchall())


def test_source_queries(spark):
    from tessera.functions import parsing

    q = entry.queries()
    snippets = [
        ("routes.py", "def get_user(request):\n    user_id = request.args.get('id')\n    return execute_query(user_id)\n"),
        ("db.py", "def execute_query(user_id):\n    sql = f'SELECT {user_id}'\n    cursor.execute(sql)\n    return sql\n"),
        ("broken.py", "def broken(:\n"),
        ("none.py", None),
    ]
    files = spark.createDataFrame(snippets, "path string, text string")
    assert {(r.caller, r.callee, r.line) for r in parsing.python_calls(files).collect()} == {("get_user", "request.args.get", 2), ("get_user", "execute_query", 3), ("execute_query", "cursor.execute", 3)}
    assert {(r.name, r.def_line, r.use_line) for r in parsing.def_use_edges(files).collect()} == {("user_id", 2, 3), ("sql", 2, 3), ("sql", 2, 4)}
    counts = {r.valid: r.n for r in q["hmac_verify"](spark, SF).collect()}
    total = spark.read.parquet(f"{SF}/events.parquet").count()
    assert sum(counts.values()) == total and counts[False] == spark.read.parquet(f"{SF}/events.parquet").filter("event_id % 7 = 0").count()


def same_as_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    rows = sorted(plain(r) for r in got.select(*columns).collect())
    assert rows == sorted(plain(r) for r in want.select(*columns).fetchall())
    return len(rows)


def test_slices_and_chains_of_whole_tables(spark, duck):
    count = lambda sql: duck.sql(sql).fetchall()[0][0]
    assert same_as_sql(spark, duck, "slice_info_all") == count("SELECT count(DISTINCT o_custkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey") > 50
    assert same_as_sql(spark, duck, "def_use_chains_all") == count("SELECT count(DISTINCT l_orderkey) FROM lineitem") > 1000


@pytest.mark.parametrize("name", ["shared_dependencies", "version_conflicts", "dependency_severity", "topic_bridge", "coupling_instability"])
def test_every_quantity_counts(spark, duck, name):
    same_as_sql(spark, duck, name + "_all")
    some, whole = (entry.queries()[n](spark, SF).collect() for n in (name, name + "_all"))
    measure = {"shared_dependencies": "versions", "version_conflicts": "versions", "dependency_severity": "findings", "topic_bridge": "topics", "coupling_instability": "ce"}[name]
    assert sum(r[measure] for r in whole) > sum(r[measure] for r in some)


def test_text_similarity_edges(spark):
    from pyspark.sql import functions as F
    from tessera.plans import text_queries as t

    rows = [("The red Fox", "a red fox is", 1.0), ("of the", "of the", 0.0), (None, "x", 0.0), ("", "", 0.0), ("uno dos", "dos tres", 1 / 3)]
    d = spark.createDataFrame(rows, "a string, b string, want double")
    got = d.select("want", t.set_similarity(t.word_set(F.col("a")), t.word_set(F.col("b"))).alias("got")).collect()
    assert all(abs(r.want - r.got) < 1e-12 for r in got)
