"""Queries over the functions of a program under traversal rules and path constraints. The starts asked for are the functions whose
key divides by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import rules as r
from tessera.operators.lineage import cut
from tessera.plans.registry import query
from tessera.sources import programs as p

DEPTH = 5


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return cut(p.code_nodes(spark, sf)), cut(p.code_edges(spark, sf))


def _compiled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _graph(spark, sf)
    return nodes, *r.compiled(nodes, edges, r.Rules("skip_external", "skip_tests", "skip_private", "complexity_weight", "confidence_weight"))


WALK = f"""WITH RECURSIVE {p.CODE}, steps AS (
  SELECT *, 1.0 * (1.0::DOUBLE / greatest(complexity, 1)) * confidence AS cost,
    CASE WHEN contains(lower(to_id), 'test') THEN 'skip_tests' WHEN contains(to_id, '::_') AND NOT contains(to_id, '::__') THEN 'skip_private' END AS dropped FROM code_edges),
walk(start, id, weight, depth, stopped) AS (SELECT id, id, 0.0::DOUBLE, 0, module = 'external' FROM code_nodes WHERE key % 20 = 0 UNION
  SELECT w.start, s.to_id, w.weight + s.cost, w.depth + 1, s.to_module = 'external' FROM walk w JOIN steps s ON s.from_id = w.id AND s.dropped IS NULL WHERE w.depth < {DEPTH} AND NOT w.stopped),
visited AS (SELECT start, id, min(weight) AS weight, arg_min(depth, (weight, depth)) AS depth, bool_or(stopped) AS stopped FROM walk GROUP BY start, id)"""


@query(WALK + " SELECT start, id, weight, depth, CASE WHEN stopped THEN 'skip_external' END AS stopped FROM visited")
def rule_weighted_reach(spark: SparkSession, sf: str) -> DataFrame:
    """The least weight of what each start reaches, the weight of an edge being the product of two rules."""
    nodes, steps, stops = _compiled(spark, sf)
    return r.weighted_traverse(steps, stops, nodes.filter("key % 20 = 0"), DEPTH)


@query(WALK + f""", hits AS (SELECT start, 'skip_external' AS rule FROM visited WHERE stopped UNION ALL
  SELECT v.start, s.dropped FROM visited v JOIN steps s ON s.from_id = v.id WHERE NOT v.stopped AND v.depth < {DEPTH} AND s.dropped IS NOT NULL)
SELECT start, rule, count(*) AS times FROM hits GROUP BY ALL""")
def rule_activations(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rule stopped or dropped something on the way."""
    nodes, steps, stops = _compiled(spark, sf)
    return r.activations(steps, r.weighted_traverse(steps, stops, nodes.filter("key % 20 = 0"), DEPTH), DEPTH)


def _pairs(nodes: DataFrame) -> r.Alike:
    """From the starts to the functions of the same brand whose key divides by 4."""
    return r.Alike(*(nodes.filter(f"key % {k} = 0").select(F.col("id").alias(name), F.col("p_brand").alias("key")) for k, name in ((20, "start"), (4, "end"))))


PATHS = f"""WITH RECURSIVE {p.CODE}, pairs AS (SELECT a.id AS start, b.id AS "end" FROM code_nodes a JOIN code_nodes b ON a.p_brand = b.p_brand WHERE a.key % 20 = 0 AND b.key % 4 = 0),
ways AS (SELECT id AS start, id AS at, [id] AS path, [type] AS types, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS weight, 0.0::DOUBLE AS trust, false AS stopped, false AS private FROM code_nodes WHERE key % 20 = 0 UNION ALL
  SELECT w.start, e.to_id, list_append(w.path, e.to_id), list_append(w.types, e.to_type), w.cost + e.confidence, w.weight + e.weight, w.trust + e.confidence, w.stopped OR (len(w.path) > 1 AND e.from_module = 'external'), w.private OR contains(e.to_id, '::_')
  FROM ways w JOIN code_edges e ON e.from_id = w.at WHERE len(w.path) <= {DEPTH} AND NOT list_contains(w.path, e.to_id))"""


@query(PATHS + """, ranked AS (SELECT w.start, w.at AS "end", path, cost AS weight, CAST(row_number() OVER (PARTITION BY w.start, w.at ORDER BY cost, path) AS INTEGER) AS rank
  FROM ways w JOIN pairs p ON p.start = w.start AND p."end" = w.at WHERE NOT stopped AND NOT private)
SELECT start, "end", rank, array_to_string(path, ' ') AS path, weight FROM ranked WHERE rank <= 3""")
def best_rule_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The three cheapest simple paths between functions under rules."""
    nodes, edges = _graph(spark, sf)
    steps, stops = r.compiled(nodes, edges, r.Rules("skip_external", "skip_private", "confidence_weight"))
    return r.best_paths(steps, stops, _pairs(nodes), DEPTH, 3).withColumn("path", F.array_join("path", " "))


@query(PATHS + """, kept AS (SELECT w.start, w.at AS "end", path, CAST(len(path) - 1 AS INTEGER) AS length, weight, trust / greatest(len(path) - 1, 1) AS confidence, types[len(types)] = 'class' AS soft
  FROM ways w JOIN pairs p ON p.start = w.start AND p."end" = w.at
  WHERE len(path) - 1 BETWEEN 1 AND 5 AND NOT contains(array_to_string(path, ' '), 'pkg_7') AND contains(array_to_string(path, ' '), 'pkg_') AND trust / greatest(len(path) - 1, 1) >= 0.9 AND weight <= 6
    AND len(list_filter(list_zip(types[:-2], types[2:]), lambda t: t[1] = 'function' AND t[2] = 'class')) > 0),
scored AS (SELECT *, 0.3 * (1.0::DOUBLE / (1.0 + length)) + 0.3 * confidence + 0.2 * (1.0::DOUBLE / (1.0 + weight)) + 0.2 * (CASE WHEN soft THEN 8 ELSE 7 END / 8.0::DOUBLE) AS score FROM kept)
SELECT start, "end", CAST(rank AS INTEGER) AS rank, array_to_string(path, ' ') AS path, length, round(score, 9) AS score, CASE WHEN soft THEN '' ELSE 'ends_in_class' END AS violated
FROM (SELECT *, row_number() OVER (PARTITION BY start, "end" ORDER BY score DESC, path) AS rank FROM scored) WHERE rank <= 5""")
def paths_under_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with hard and soft constraints by score; confidence, weights and counts come from the edges."""
    nodes, edges = _graph(spark, sf)
    want = r.Constraints(1, DEPTH, ("pkg_",), ("pkg_7",), None, None, 0.9, 6.0, "function->class", {"ends_in_class": ("element_at(types, -1) = 'class'", False)})
    found = r.constrained_paths(nodes, edges, _pairs(nodes), want, max_paths=5)
    return found.select("start", "end", "rank", F.array_join("path", " ").alias("path"), "length", F.round("score", 9).alias("score"), F.array_join("violated", ",").alias("violated"))
