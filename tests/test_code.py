"""Queries over lines of source files: small files make many lines, which no plan may broadcast."""

from __future__ import annotations

import __spark_entry__ as entry
import duckdb
import pytest
from pyspark.sql import functions as F
from tessera.plans import code_queries as c

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["api_surface", "docstring_coverage", "control_dependencies", "unreachable_lines", "unused_assignments", "extract_functions", "source_calls", "code_smells", "loop_invariants", "parameter_sinks", "manifest_check"])
def test_lines_are_not_broadcast(spark, name):
    got = entry.queries()[name](spark, SF)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    d = duckdb.connect()
    d.sql(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    columns = sorted(got.columns)
    rows = lambda found: sorted(tuple(str(x) for x in r) for r in found)
    assert rows(got.select(*columns).collect()) == rows(d.sql(entry.oracle_sql()[name]).select(*columns).fetchall())


def test_symbols_of_odd_files(spark):
    texts = [(1, "a.py", "def f(x):\n    \"\"\"says\"\"\"\n    return x\ndef g():\n    return 1\ndef h():"), (2, "b.py", "x = 1"), (3, "c.py", "")]
    d = spark.createDataFrame(texts, "file_id int, path string, code string").select("file_id", "path", F.posexplode(F.split("code", "\n")).alias("p", "line"))
    lines = d.select("file_id", "path", (F.col("p") + 1).alias("pos"), "line", ((F.length("line") - F.length(F.ltrim("line"))) / 4).cast("int").alias("indent"))
    assert sorted((r.name, r.parameters, r.start, r.stop, r.documented) for r in c.symbols(lines).collect()) == [("f", "x", 1, 3, True), ("g", "", 4, 5, False), ("h", "", 6, 6, None)]
