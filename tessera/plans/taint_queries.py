"""Queries over the taint of a program of several modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import taint
from tessera.operators.lineage import cut
from tessera.plans.registry import query
from tessera.sources import programs as p

KINDS = ("SQL", "HTML", "SHELL")


def _facts(spark: SparkSession, sf: str, rounds: int | None = None) -> tuple[taint.Program, DataFrame]:
    program = {name: cut(relation) for name, relation in p.functions(spark, sf).items()}
    return program, taint.transfers(program, KINDS, rounds)


@query(f"""WITH RECURSIVE {p.FUNCTIONS_ANY_DEPTH} SELECT fn, count(*) FILTER (WHERE parameter = 'a') AS from_a, count(*) FILTER (WHERE parameter = 'b') AS from_b, count(DISTINCT from_fn) AS sources
FROM w WHERE fn % 3 <> 0 GROUP BY fn""")
def return_transfers(spark: SparkSession, sf: str) -> DataFrame:
    """What each function returns: the kinds of sinks that its parameters stay dangerous to, and the sources, through calls of any depth."""
    program, facts = _facts(spark, sf)
    r = taint.returned(program, facts)
    return r.groupBy("fn").agg(F.count_if(F.col("parameter") == "a").alias("from_a"), F.count_if(F.col("parameter") == "b").alias("from_b"), F.countDistinct("from_fn").alias("sources"))


@query(f"""WITH RECURSIVE {p.FUNCTIONS_ANY_DEPTH} SELECT fn, parameter, count(DISTINCT (sink_fn, sink_line)) AS sinks, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
FROM hits WHERE parameter IS NOT NULL GROUP BY ALL""")
def parameter_reach(spark: SparkSession, sf: str) -> DataFrame:
    """The sinks that a function's parameters reach through up to five calls (J8), where what calls return comes from any depth."""
    hits = taint.sink_hits(*_facts(spark, sf)).filter("parameter IS NOT NULL")
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), ",")
    return hits.groupBy("fn", "parameter").agg(F.countDistinct("sink_fn", "sink_line").alias("sinks"), kinds.alias("kinds"))


@query(f"""WITH RECURSIVE {p.FUNCTIONS} SELECT DISTINCT a.module AS source_module, from_fn AS source_fn, 2 AS source_line, b.module AS sink_module, sink_fn, sink_line, kind,
  CASE kind WHEN 'HTML' THEN 'LOW' ELSE 'HIGH' END AS severity, CASE kind WHEN 'SQL' THEN 89 WHEN 'HTML' THEN 79 ELSE 78 END AS cwe
FROM hits JOIN f a ON a.fn = from_fn JOIN f b ON b.fn = sink_fn WHERE parameter IS NULL AND a.module <> b.module""")
def cross_file_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows from a source in one module to a sink in another, with severity and CWE."""
    program, facts = _facts(spark, sf, rounds=3)
    return taint.vulnerabilities(program, taint.sink_hits(program, facts))
