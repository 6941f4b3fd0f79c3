"""Queries over the flow graphs of procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import flow
from tessera.operators.lineage import cut
from tessera.plans.registry import query
from tessera.sources import programs as p


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes = cut(p.flow_nodes(spark, sf))
    return nodes, p.flow_edges(nodes)


@query(f"""WITH RECURSIVE {p.FLOW}, live(proc, node, variable, definition) AS (
  SELECT d.proc, e.b, d.variable, d.node FROM defs d JOIN edges e ON e.proc = d.proc AND e.a = d.node UNION
  SELECT l.proc, e.b, l.variable, l.definition FROM live l JOIN edges e ON e.proc = l.proc AND e.a = l.node JOIN defs d ON d.proc = l.proc AND d.node = l.node WHERE d.variable <> l.variable)
SELECT l.proc, l.node, l.definition FROM live l JOIN uses u USING (proc, node, variable)""")
def definition_uses(spark: SparkSession, sf: str) -> DataFrame:
    """The definitions that may reach each statement that reads the variable, loops and branches considered."""
    nodes, edges = _graph(spark, sf)
    return flow.reaching_definitions(edges, p.definitions(nodes), p.uses(nodes)).select("proc", "node", "definition")


LIVE = f"""WITH RECURSIVE {p.FLOW}, live(proc, node, variable) AS (
  SELECT u.proc, e.a, u.variable FROM uses u JOIN edges e ON e.proc = u.proc AND e.b = u.node UNION
  SELECT l.proc, e.a, l.variable FROM live l JOIN edges e ON e.proc = l.proc AND e.b = l.node JOIN defs d ON d.proc = l.proc AND d.node = l.node WHERE d.variable <> l.variable)"""


@query(LIVE + " SELECT proc, node, string_agg(variable, ',' ORDER BY variable) AS live, count(*) AS n FROM live GROUP BY proc, node")
def live_variables(spark: SparkSession, sf: str) -> DataFrame:
    """The variables that are live after each statement."""
    nodes, edges = _graph(spark, sf)
    live = flow.live_variables(edges, p.definitions(nodes), p.uses(nodes))
    return live.groupBy("proc", "node").agg(F.array_join(F.array_sort(F.collect_list("variable")), ",").alias("live"), F.count(F.lit(1)).alias("n"))


@query(LIVE + " SELECT proc, node, variable FROM defs d WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.proc = d.proc AND l.node = d.node AND l.variable = d.variable)")
def dead_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """The definitions that nothing reads."""
    nodes, edges = _graph(spark, sf)
    return flow.dead_definitions(edges, p.definitions(nodes), p.uses(nodes))


#: reach: nodes from the entry; avoid: nodes from the entry on ways that do not meet d; dom: what is reached and not that way.
DOMINATORS = f"""WITH RECURSIVE {p.FLOW}, reach(proc, node) AS (SELECT DISTINCT proc, CAST(1 AS BIGINT) FROM nodes UNION SELECT r.proc, e.b FROM reach r JOIN edges e ON e.proc = r.proc AND e.a = r.node),
avoid(proc, d, node) AS (SELECT proc, node, CAST(1 AS BIGINT) FROM nodes WHERE node <> 1 UNION SELECT v.proc, v.d, e.b FROM avoid v JOIN edges e ON e.proc = v.proc AND e.a = v.node WHERE e.b <> v.d),
dom AS (SELECT x.proc, x.node, y.node AS dominator FROM reach x JOIN reach y ON x.proc = y.proc ANTI JOIN avoid v ON v.proc = x.proc AND v.node = x.node AND v.d = y.node)"""


def _entered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _graph(spark, sf)
    return edges, nodes.filter("node = 1").select("proc", "node")


@query(DOMINATORS + """, depth AS (SELECT proc, node, count(*) AS depth FROM dom GROUP BY ALL)
SELECT d.proc, d.node, arg_max(d.dominator, p.depth) AS dominator, count(*) AS n FROM dom d JOIN depth p ON p.proc = d.proc AND p.node = d.dominator WHERE d.node <> d.dominator GROUP BY d.proc, d.node""")
def immediate_dominators(spark: SparkSession, sf: str) -> DataFrame:
    """Each statement's immediate dominator and the number of its dominators (P20, P25)."""
    return flow.immediate_dominators(flow.dominators(*_entered(spark, sf)))


@query(DOMINATORS + """, back AS (SELECT e.proc, e.b AS header, e.a AS node FROM edges e JOIN dom d ON d.proc = e.proc AND d.node = e.a AND d.dominator = e.b),
body(proc, header, node) AS (SELECT proc, header, node FROM back UNION
  SELECT y.proc, y.header, e.a FROM body y JOIN edges e ON e.proc = y.proc AND e.b = y.node JOIN reach r ON r.proc = e.proc AND r.node = e.a WHERE y.node <> y.header),
whole AS (SELECT * FROM body UNION SELECT proc, header, header FROM back)
SELECT proc, header, string_agg(node, ',' ORDER BY node) AS body, count(*) AS n FROM whole GROUP BY ALL""")
def natural_loops(spark: SparkSession, sf: str) -> DataFrame:
    """The loops of each procedure and the statements in them."""
    body = F.array_sort(F.collect_list("node")).cast("array<string>")
    return flow.loops(*_entered(spark, sf)).groupBy("proc", "header").agg(F.array_join(body, ",").alias("body"), F.count(F.lit(1)).alias("n"))
