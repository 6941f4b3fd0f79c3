"""Written tables and small driver tables that make large relations are never sent through the driver."""

from __future__ import annotations

import __spark_entry__ as entry
from pyspark.sql import functions as F
from tessera.operators import graph, structure
from tessera.operators.lineage import cut, together
from tessera.sources import programs as p
from tessera.sources import views as v

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_not_broadcast(spark):
    a, b = (cut(spark.range(20).toDF(c)) for c in ("x", "y"))
    same = F.col("x") == F.col("y")
    for df in (a.join(b, same), spark.range(9).toDF("x").join(b.filter("y > 3").distinct(), same, "left_anti"), a.join(together([b, b]), same)):
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)
    assert a.join(together([a, a]).withColumnRenamed("x", "y"), same).count() == 40


def test_module_edges_do_not_broadcast_parts(spark):
    assert "Broadcast" not in plan(v.m_edges(spark, SF))
    assert "Broadcast" not in plan(p.code_edges(spark, SF))


def test_bridge_holds_no_arrays_of_topics(spark):
    assert "collect_set" not in plan(entry.queries()["topic_bridge_all"](spark, SF))


def test_trimming_broadcasts_no_ends(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(structure, "cut", lambda df: (plans.append(plan(df)), cut(df))[1])
    e = cut(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (4, 5)], "a int, b int"))
    assert {tuple(r) for r in structure._trimmed(e).collect()} == {(2, 3), (3, 2)}
    assert plans and not any("Broadcast" in x for x in plans)


def test_closures_broadcast_nothing_seen(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "cut", lambda df: (plans.append(plan(df)), cut(df))[1])
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("c", "d")], "from_id string, to_id string")
    ends = [spark.createDataFrame([(x,)], "id string") for x in "ac"]
    assert {(r.from_id, r.to_id) for r in graph.between(e, *ends).collect()} == {("a", "b"), ("b", "c")}
    assert len(plans) > 3 and not any("Broadcast" in x for x in plans)
