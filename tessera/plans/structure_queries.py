"""Queries over the dependency graph of modules: strong components, their cycles, order and betweenness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import centrality as c
from tessera.operators import structure as s
from tessera.operators.lineage import cut
from tessera.plans.registry import query
from tessera.sources import views as v


def _modules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Edges and strong components."""
    edges = cut(v.m_edges(spark, sf))
    return edges, s.strong_components(edges)


#: nodes; reach: pairs of different nodes on a way; strong: the least node that a node reaches and that reaches it.
STRONG = f"""WITH RECURSIVE {v.M_EDGES}, nodes AS (SELECT from_id AS id FROM m_edges UNION SELECT to_id FROM m_edges),
reach AS (SELECT from_id AS a, to_id AS b FROM m_edges UNION SELECT r.a, e.to_id FROM reach r JOIN m_edges e ON e.from_id = r.b),
strong AS (SELECT id, least(id, coalesce(min(r.b), id)) AS component FROM nodes LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) r ON r.a = id GROUP BY id)"""


@query(STRONG + " SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM strong")
def strong_components(spark: SparkSession, sf: str) -> DataFrame:
    """Each module's strongly connected component and its size."""
    _, found = _modules(spark, sf)
    sizes = found.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, F.col("component") == F.col("c")).select("id", "component", "size")


@query(STRONG + """, inner_edges AS (SELECT a.component, e.from_id AS a, e.to_id AS b FROM m_edges e JOIN strong a ON a.id = e.from_id JOIN strong b ON b.id = e.to_id AND b.component = a.component),
far(component, x, d) AS (SELECT DISTINCT component, component, 0 FROM inner_edges UNION
  SELECT f.component, e.a, f.d + 1 FROM far f JOIN inner_edges e ON e.component = f.component AND e.b = f.x WHERE e.a <> f.component AND f.d < (SELECT max(n) FROM (SELECT count(*) AS n FROM strong GROUP BY component))),
least_far AS (SELECT component, x, min(d) AS d FROM far GROUP BY ALL),
onward AS (SELECT e.component, e.a, min_by(e.b, (f.d, e.b)) AS b FROM inner_edges e JOIN least_far f ON f.component = e.component AND f.x = e.b GROUP BY ALL),
walk AS (SELECT component, component AS x, [component] AS cycle FROM (SELECT DISTINCT component FROM inner_edges) UNION ALL
  SELECT w.component, o.b, list_append(w.cycle, o.b) FROM walk w JOIN onward o ON o.component = w.component AND o.a = w.x WHERE o.b <> w.component)
SELECT component, arg_max(array_to_string(cycle, '->'), len(cycle)) AS cycle, CAST(max(len(cycle)) AS INTEGER) AS length FROM walk GROUP BY component""")
def component_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest cycle through the least module of each component, of any length."""
    edges, found = _modules(spark, sf)
    cycles = s.component_cycles(edges, found)
    return cycles.select("component", F.array_join(F.col("cycle").cast("array<string>"), "->").alias("cycle"), F.size("cycle").alias("length"))


@query(STRONG + """, steps AS (SELECT DISTINCT a.component AS a, b.component AS b FROM m_edges e JOIN strong a ON a.id = e.from_id JOIN strong b ON b.id = e.to_id),
depth AS (SELECT DISTINCT component, 0 AS level FROM strong UNION SELECT s.b, d.level + 1 FROM depth d JOIN steps s ON s.a = d.component AND s.a <> s.b),
cyclic AS (SELECT component FROM strong GROUP BY component HAVING count(*) > 1),
behind AS (SELECT component FROM cyclic UNION SELECT s.b FROM behind c JOIN steps s ON s.a = c.component)
SELECT id, s.component, (SELECT max(level) FROM depth d WHERE d.component = s.component) AS level, s.component IN (SELECT component FROM behind) AS last FROM strong s""")
def condensed_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each module's place in an order over the graph of components, with those on or behind a cycle marked as last."""
    return s.condensed_order(*_modules(spark, sf))


#: far: least number of steps by pair; ways: the number of shortest ways by pair, one depth a round.
FAR = f"""WITH RECURSIVE {v.M_EDGES}, nodes AS (SELECT from_id AS id FROM m_edges UNION SELECT to_id FROM m_edges),
far(a, b, d) USING KEY (a, b) AS (SELECT id, id, 0 FROM nodes UNION
  SELECT f.a, e.to_id, min(f.d) + 1 FROM far f JOIN m_edges e ON e.from_id = f.b LEFT JOIN recurring.far r ON r.a = f.a AND r.b = e.to_id WHERE r.d IS NULL GROUP BY f.a, e.to_id),
ways(a, b, d, n) AS (SELECT id, id, 0, 1.0::DOUBLE FROM nodes UNION ALL
  SELECT w.a, e.to_id, w.d + 1, sum(w.n) FROM ways w JOIN m_edges e ON e.from_id = w.b JOIN far f ON f.a = w.a AND f.b = e.to_id AND f.d = w.d + 1 GROUP BY w.a, e.to_id, w.d)"""


@query(FAR + """, through AS (
  SELECT x.b AS id, sum(x.n * y.n / z.n) AS share FROM ways x JOIN ways y ON y.a = x.b JOIN ways z ON z.a = x.a AND z.b = y.b AND z.d = x.d + y.d WHERE x.a <> x.b AND y.a <> y.b GROUP BY x.b),
counts AS (SELECT count(*) AS n FROM nodes)
SELECT id, (SELECT count(*) FROM m_edges e WHERE e.to_id = id) AS in_degree, (SELECT count(*) FROM m_edges e WHERE e.from_id = id) AS out_degree,
  (SELECT count(*) FROM far f WHERE f.a = id AND f.d > 0) AS reachable, (SELECT count(*) FROM far f WHERE f.b = id AND f.d > 0) AS dependents,
  round(coalesce(share, 0) / ((n - 1) * (n - 2)), 12) AS betweenness FROM nodes LEFT JOIN through USING (id), counts""")
def node_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees, sizes of the closures and betweenness of every module."""
    return c.node_metrics(v.m_edges(spark, sf)).withColumn("betweenness", F.round("betweenness", 12))
