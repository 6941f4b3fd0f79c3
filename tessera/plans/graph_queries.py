"""Graph queries of the catalogue: language, traversal, paths, cycles, levels, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.plans.registry import query
from tessera.sources import views as v


def _nodes_query(name: str, text: str, where: str, tail: str = "") -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return g.select_nodes(v.g_nodes(spark, sf), text)

    run.__doc__ = f"Nodes by the query language: {text} (G1 to G11)."
    query(f"WITH {v.G_NODES} SELECT * FROM g_nodes WHERE {where} {tail}", name)(run)


_nodes_query("graph_filter_numeric", "WHERE score > 1000 ORDER BY score DESC LIMIT 50", "score > 1000", "ORDER BY score DESC, id LIMIT 50")
_nodes_query("graph_filter_contains", "WHERE type = customer AND name contains '00001'", "type = 'customer' AND contains(name, '00001')")
_nodes_query("graph_filter_prefix", "WHERE type = supplier AND id starts_with 'supplier:1'", "type = 'supplier' AND id LIKE 'supplier:1%'")
_nodes_query("graph_filter_suffix", "WHERE module ends_with 'A' AND score >= 0", "module LIKE '%A' AND score >= 0")
_nodes_query("graph_filter_regex", "WHERE type != order AND id matches ':[0-9]*7$'", "type <> 'order' AND regexp_matches(id, ':[0-9]*7$')")


@query(f"WITH {v.G_NODES} SELECT * FROM g_nodes WHERE type = 'part' ORDER BY score, id LIMIT 20 OFFSET 10")
def graph_skip_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 11 to 30 of the parts by score."""
    return g.select_nodes(v.g_nodes(spark, sf), g.GraphQuery([("type", "=", "part")], "score", False, 20, 10))


@query(f"WITH {v.G_EDGES} SELECT type, count(*) AS n_edges, round(avg(confidence), 6) AS mean_confidence FROM g_edges WHERE type IN ('contains', 'placed') AND confidence BETWEEN 0.92 AND 0.97 GROUP BY type")
def edge_filter_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Edges by type and confidence band."""
    kept = g.filter_edges(v.g_edges(spark, sf), ("contains", "placed"), 0.92, 0.97)
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"""WITH {v.G_NODES}, {v.G_EDGES}, s AS (SELECT id FROM g_nodes WHERE score > 1500)
SELECT from_id, to_id, type FROM g_edges WHERE from_id IN (SELECT id FROM s) AND to_id IN (SELECT id FROM s)""")
def edges_between_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose two ends were selected."""
    nodes = g.select_nodes(v.g_nodes(spark, sf), "WHERE score > 1500")
    return g.induced(nodes, v.g_edges(spark, sf)).select("from_id", "to_id", "type")


@query(f"""WITH {v.G_EDGES} SELECT type, count(*) FILTER (WHERE confidence >= 0.8) AS definite, count(*) FILTER (WHERE confidence < 0.8) AS uncertain,
  bool_or(confidence < 0.8) AS needs_approval FROM g_edges GROUP BY type""")
def dependency_split(spark: SparkSession, sf: str) -> DataFrame:
    """Definite and uncertain dependencies at .8 and the approval flag."""
    sure = F.col("confidence") >= 0.8
    return v.g_edges(spark, sf).groupBy("type").agg(F.count_if(sure).alias("definite"), F.count_if(~sure).alias("uncertain"), F.bool_or(~sure).alias("needs_approval"))


BANDS = "CASE WHEN confidence >= 1.0 THEN 'definite' WHEN confidence >= 0.95 THEN 'high' WHEN confidence >= 0.8 THEN 'medium' ELSE 'low' END"


@query(f"WITH {v.G_EDGES} SELECT type, {BANDS} AS level, count(*) AS n FROM g_edges GROUP BY ALL")
def confidence_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Edges by type and confidence band."""
    return v.g_edges(spark, sf).groupBy("type", F.expr(BANDS).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {v.G_NODES} SELECT split_part(id, ':', 1) AS kind, max(CAST(split_part(id, ':', 2) AS BIGINT)) AS greatest_key, count(*) AS n FROM g_nodes GROUP BY ALL")
def node_id_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of node ids."""
    kind, key = F.split_part("id", F.lit(":"), F.lit(1)), F.split_part("id", F.lit(":"), F.lit(2))
    return v.g_nodes(spark, sf).groupBy(kind.alias("kind")).agg(F.max(key.cast("long")).alias("greatest_key"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {v.G_EDGES}, d AS (SELECT from_id AS id, 1 AS o, 0 AS i FROM g_edges UNION ALL SELECT to_id, 0, 1 FROM g_edges)
SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM d GROUP BY id ORDER BY degree DESC, id DESC LIMIT 10""")
def degree_hot_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nodes of the highest degree."""
    e = v.g_edges(spark, sf)
    ends = e.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree"))
    return d.orderBy(F.desc("degree"), F.desc("id")).limit(10)


def _walk_sql(seeds: str, k: int, keep: str = "TRUE") -> str:
    return f"""WITH RECURSIVE {v.G_EDGES}, step AS (
  SELECT from_id AS a, to_id AS b FROM g_edges WHERE {keep} UNION SELECT to_id, from_id FROM g_edges WHERE {keep}),
walk AS (SELECT id, 0 AS depth FROM (VALUES {seeds}) s(id)
  UNION SELECT step.b, walk.depth + 1 FROM walk JOIN step ON step.a = walk.id WHERE walk.depth < {k}),
hop AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


SEEDS = ("supplier:1", "supplier:2", "nation:3")
SEED_SQL = "('supplier:1'), ('supplier:2'), ('nation:3')"


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SEEDS], "id string")


@query(_walk_sql(SEED_SQL, 2) + " SELECT id, depth FROM hop")
def khop_neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    """Least depth of every node within two hops of three seeds, either way."""
    return g.traverse(v.g_edges(spark, sf), _seeds(spark), 2, "both")


@query(_walk_sql(SEED_SQL, 2, "confidence >= 0.99 AND type <> 'shipped_by'") + " SELECT id, depth FROM hop")
def khop_confident(spark: SparkSession, sf: str) -> DataFrame:
    """The same over confident edges only."""
    kept = g.filter_edges(v.g_edges(spark, sf), ("placed", "contains", "located_in", "part_of"), 0.99, 1.0)
    return g.traverse(kept, _seeds(spark), 2, "both")


@query(_walk_sql(SEED_SQL, 2) + " SELECT id, depth, count(*) OVER () > 100 AS truncated FROM hop ORDER BY depth, id LIMIT 100")
def khop_truncated(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred nodes by depth and id, and whether more were cut."""
    near = g.traverse(v.g_edges(spark, sf), _seeds(spark), 2, "both")
    total = near.agg((F.count(F.lit(1)) > 100).alias("truncated"))
    return near.orderBy("depth", "id").limit(100).join(F.broadcast(total))


@query(f"""WITH RECURSIVE {v.G_EDGES}, step AS (SELECT from_id AS a, to_id AS b, type FROM g_edges WHERE type <> 'contains'),
walk AS (SELECT 'customer:1' AS id, 0 AS depth UNION
  SELECT s.b, w.depth + 1 FROM walk w JOIN step s ON s.a = w.id WHERE w.depth < 4 AND w.id NOT LIKE 'nation:%'),
hop AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)
SELECT split_part(id, ':', 1) AS kind, depth, count(*) AS n, bool_or(id LIKE 'nation:%') AS stopped FROM hop GROUP BY ALL""")
def rule_traversal(spark: SparkSession, sf: str) -> DataFrame:
    """Walk with a boundary rule (nations are not expanded) and an edge rule (no contents); activations by kind."""
    kept = v.g_edges(spark, sf).filter("type <> 'contains' AND from_id NOT LIKE 'nation:%'")
    near = g.traverse(kept, spark.createDataFrame([("customer:1",)], "id string"), 4)
    kind = F.split_part("id", F.lit(":"), F.lit(1))
    return near.groupBy(kind.alias("kind"), "depth").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("id").startswith("nation:")).alias("stopped"))


@query(f"""WITH RECURSIVE {v.S_EDGES}, walk AS (SELECT 'signup' AS id, 0 AS hops, CAST(0 AS DOUBLE) AS cost UNION
  SELECT e.to_id, w.hops + 1, w.cost + 1000.0 / e.n FROM walk w JOIN s_edges e ON e.from_id = w.id WHERE w.hops < 3)
SELECT id, round(min(cost), 6) AS cost FROM walk GROUP BY id""")
def weighted_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Least cost within three hops on the event graph (T5)."""
    found = g.least_cost(v.s_edges(spark, sf), spark.createDataFrame([("signup",)], "id string"), 1000.0 / F.col("n"), 3)
    return found.select("id", F.round("cost", 6).alias("cost"))


@query(f"""WITH RECURSIVE {v.U_EDGES}, walk AS (SELECT src AS id, 0 AS depth FROM (SELECT min(src) AS src FROM u_edges) UNION
  SELECT u.dst, w.depth + 1 FROM walk w JOIN u_edges u ON u.src = w.id WHERE w.depth < 3)
SELECT id, min(depth) AS depth FROM walk GROUP BY id""")
def reachable_from_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Nations within three hops of the entry."""
    e = v.u_edges(spark, sf)
    return g.traverse(e.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id")), e.agg(F.min("src").alias("id")), 3)


PATHS = f"""WITH RECURSIVE {v.S_EDGES}, walk AS (
  SELECT [from_id, to_id] AS path FROM s_edges WHERE from_id <> to_id UNION ALL
  SELECT list_append(w.path, e.to_id) FROM walk w JOIN s_edges e ON e.from_id = w.path[-1] WHERE len(w.path) < 5 AND NOT list_contains(w.path, e.to_id))"""


@query(PATHS + " SELECT array_to_string(path, '->') AS path, CAST(len(path) - 1 AS INTEGER) AS length FROM walk")
def all_simple_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Simple paths of up to four edges on the event graph."""
    found = g.simple_paths(v.s_edges(spark, sf), 4)
    return found.select(F.array_join("path", "->").alias("path"), (F.size("path") - 1).alias("length"))


@query(PATHS + """ SELECT array_to_string(path, '->') AS path, round(0.3 / (1 + len(path) - 1) + 0.3 * 0.9 + 0.2 / (1 + len(path) - 1) + 0.2 * 3 / 3, 6) AS score
FROM walk WHERE list_contains(path, 'view') AND NOT list_contains(path, 'error') AND len(path) - 1 BETWEEN 2 AND 4 ORDER BY score DESC, path LIMIT 20""")
def constrained_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with length, must-visit and must-avoid constraints by score."""
    length = F.size("path") - 1
    kept = g.simple_paths(v.s_edges(spark, sf), 4).filter(F.array_contains("path", "view") & ~F.array_contains("path", "error") & length.between(2, 4))
    score = g.path_score(length, F.lit(0.9), length, F.lit(3), F.lit(0))
    return kept.select(F.array_join("path", "->").alias("path"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), "path").limit(20)


@query(PATHS + " SELECT CAST(len(path) - 1 AS INTEGER) AS length, count(*) AS n_paths FROM walk GROUP BY ALL")
def path_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Paths by length."""
    return g.path_statistics(g.simple_paths(v.s_edges(spark, sf), 4))


@query("""SELECT 'customer->order->part' AS pattern, count(*) AS n_paths, count(DISTINCT o_custkey) AS n_starts FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def path_pattern_match(spark: SparkSession, sf: str) -> DataFrame:
    """Paths whose node types are customer, order, part."""
    e = v.g_edges(spark, sf)
    first = e.filter("type = 'placed'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    second = e.filter("type = 'contains'").select(F.col("from_id").alias("b2"), F.col("to_id").alias("c"))
    return first.join(second, F.col("b") == F.col("b2")).agg(F.lit("customer->order->part").alias("pattern"), F.count(F.lit(1)).alias("n_paths"), F.countDistinct("a").alias("n_starts")).select("pattern", "n_paths", "n_starts")


@query(PATHS + """, closed AS (SELECT path FROM walk WHERE list_min(path) = path[1] AND EXISTS (SELECT 1 FROM s_edges e WHERE e.from_id = path[-1] AND e.to_id = path[1]))
SELECT array_to_string(path, '->') AS cycle, CAST(len(path) AS INTEGER) AS length FROM closed WHERE len(path) <= 4""")
def cycles_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of two to four nodes, least node first."""
    found = g.cycles(v.s_edges(spark, sf), 4)
    return found.select(F.array_join("path", "->").alias("cycle"), F.size("path").alias("length"))


@query(f"""WITH RECURSIVE {v.U_EDGES}, both_ways AS (SELECT src AS a, dst AS b FROM u_edges UNION SELECT dst, src FROM u_edges),
reach AS (SELECT a AS id, a AS seen FROM both_ways UNION SELECT r.id, b.b FROM reach r JOIN both_ways b ON b.a = r.seen)
SELECT id, min(seen) AS component FROM reach GROUP BY id""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the nation graph."""
    e = v.u_edges(spark, sf).select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"))
    return g.components(e)


@query("""SELECT level, count(*) AS n FROM (
  SELECT 0 AS level FROM region UNION ALL SELECT 1 FROM nation UNION ALL SELECT 2 FROM customer UNION ALL SELECT 3 FROM orders) GROUP BY level""")
def topological_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Longest level of each node of the region, nation, customer, order hierarchy."""
    e = v.g_edges(spark, sf)
    down = e.filter("type IN ('part_of', 'located_in') AND from_id NOT LIKE 'supplier:%'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    down = down.unionByName(e.filter("type = 'placed'").select("from_id", "to_id"))
    seeds = e.filter("type = 'part_of'").select(F.col("to_id").alias("id"))
    near = g.traverse(down, seeds, 3).unionByName(v.table(spark, sf, "region").select(v.node_id("region", "r_regionkey").alias("id"), F.lit(0).alias("depth")))
    return near.distinct().groupBy(F.col("depth").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(c_nationkey AS INTEGER) AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_suppkey IN (1, 2, 3) GROUP BY c_nationkey HAVING count(DISTINCT l_suppkey) = 3""")
def common_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Nations reached from all of three suppliers."""
    t = lambda n: v.table(spark, sf, n)
    line = t("lineitem").filter(F.col("l_suppkey").isin(1, 2, 3)).select("l_orderkey", "l_suppkey")
    joined = line.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("nation")).agg(F.countDistinct("l_suppkey").alias("k")).filter("k = 3").select("nation")


@query(f"""WITH RECURSIVE {v.U_EDGES}, walk AS (SELECT src AS id, 0 AS depth FROM (SELECT min(src) AS src FROM u_edges) UNION
  SELECT u.dst, w.depth + 1 FROM walk w JOIN u_edges u ON u.src = w.id WHERE w.depth < 4)
SELECT id, min(depth) AS depth, round(power(0.9, min(depth)), 4) AS confidence FROM walk GROUP BY id""")
def confidence_decay_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence by depth of extraction."""
    e = v.u_edges(spark, sf)
    near = g.traverse(e.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id")), e.agg(F.min("src").alias("id")), 4)
    return near.withColumn("confidence", F.round(F.pow(F.lit(0.9), "depth"), 4))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders),
chain AS (SELECT id, id AS target, 0 AS hops FROM o UNION ALL SELECT c.id, o.previous, c.hops + 1 FROM chain c JOIN o ON o.id = c.target WHERE o.previous IS NOT NULL AND c.hops < 5)
SELECT id, max_by(target, hops) AS target, max(hops) AS hops FROM chain GROUP BY id""")
def alias_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's chain of previous orders of its customer, at most five hops."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    lags = [F.lag("o_orderkey", k).over(w) for k in range(5, 0, -1)]
    hops = F.least(F.lit(5), F.row_number().over(w) - 1)
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(*lags, F.col("o_orderkey")).alias("target"), hops.alias("hops"))
