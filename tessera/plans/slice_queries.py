"""Slicing and def-use queries of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import graph as g
from tessera.plans.registry import query
from tessera.sources import views as v

FLOW = f"{v.G_EDGES}, flow AS (SELECT from_id AS a, to_id AS b, type FROM g_edges WHERE type IN ('placed', 'contains'))"


def _flow(spark: SparkSession, sf: str) -> DataFrame:
    return v.g_edges(spark, sf).filter("type IN ('placed', 'contains')")


def _one(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _reach(name: str, seeds: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT id FROM (VALUES {seeds}) s(id) UNION SELECT flow.{b} FROM {name} JOIN flow ON flow.{a} = {name}.id)"


@query(f"WITH RECURSIVE {FLOW}, {_reach('r', chr(40) + chr(39) + 'part:1' + chr(39) + chr(41), 'b', 'a')} SELECT id FROM r")
def backward_slice(spark: SparkSession, sf: str) -> DataFrame:
    """All that a part depends on."""
    return g.closure(_flow(spark, sf), _one(spark, "part:1"), "in").select("id")


@query(f"WITH RECURSIVE {FLOW}, {_reach('r', chr(40) + chr(39) + 'customer:1' + chr(39) + chr(41), 'a', 'b')} SELECT id FROM r")
def forward_slice(spark: SparkSession, sf: str) -> DataFrame:
    """All that a customer affects."""
    return g.closure(_flow(spark, sf), _one(spark, "customer:1"), "out").select("id")


@query(f"WITH {FLOW} SELECT DISTINCT a AS id, type FROM flow WHERE b = 'part:1'")
def thin_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Direct predecessors only (P5)."""
    return _flow(spark, sf).filter("to_id = 'part:1'").select(F.col("from_id").alias("id"), "type").distinct()


@query(f"""WITH RECURSIVE {FLOW}, {_reach('f', "('customer:1')", 'a', 'b')},
p AS (SELECT b AS id FROM flow WHERE a IN (SELECT id FROM f WHERE id LIKE 'order:%') ORDER BY 1 LIMIT 1),
k AS (SELECT id FROM p UNION SELECT flow.a FROM k JOIN flow ON flow.b = k.id)
SELECT id FROM f INTERSECT SELECT id FROM k""")
def chop(spark: SparkSession, sf: str) -> DataFrame:
    """What lies between a customer and its first part: forward and backward slice together."""
    flow = _flow(spark, sf)
    forward = g.closure(flow, _one(spark, "customer:1"), "out").select("id")
    target = forward.filter("id LIKE 'part:%'").orderBy("id").limit(1)
    return forward.intersect(g.closure(flow, target, "in").select("id"))


TWO = f"""WITH RECURSIVE {FLOW}, w AS (SELECT s.id AS seed, s.id FROM (VALUES ('part:1'), ('part:2')) s(id) UNION SELECT w.seed, flow.a FROM w JOIN flow ON flow.b = w.id)"""


def _two(spark: SparkSession, sf: str) -> DataFrame:
    flow = _flow(spark, sf)
    parts = [g.closure(flow, _one(spark, s), "in").select("id", F.lit(s).alias("seed")) for s in ("part:1", "part:2")]
    return parts[0].unionByName(parts[1])


@query(TWO + " SELECT DISTINCT id FROM w")
def slice_union(spark: SparkSession, sf: str) -> DataFrame:
    """Union of two backward slices."""
    return _two(spark, sf).select("id").distinct()


@query(TWO + " SELECT id FROM w GROUP BY id HAVING count(DISTINCT seed) = 2")
def slice_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection of two backward slices."""
    return _two(spark, sf).groupBy("id").agg(F.countDistinct("seed").alias("n")).filter("n = 2").select("id")


@query(f"""WITH RECURSIVE {FLOW}, {_reach('r', "('customer:1')", 'a', 'b')}, e AS (SELECT * FROM flow WHERE a IN (SELECT id FROM r) AND b IN (SELECT id FROM r))
SELECT r.id, (SELECT count(*) FROM e WHERE e.b = r.id) > 1 AS core, (SELECT count(*) FROM e WHERE e.a = r.id) = 0 AS auxiliary FROM r""")
def slice_components(spark: SparkSession, sf: str) -> DataFrame:
    """Core (in-degree above 1) and auxiliary (out-degree 0) nodes of a slice."""
    flow = _flow(spark, sf)
    nodes = g.closure(flow, _one(spark, "customer:1"), "out").select("id")
    e = g.induced(nodes, flow)
    into, out = e.groupBy(F.col("to_id").alias("i")).count().withColumnRenamed("count", "ni"), e.groupBy(F.col("from_id").alias("o")).count().withColumnRenamed("count", "no")
    joined = nodes.join(into, F.col("id") == F.col("i"), "left").join(out, F.col("id") == F.col("o"), "left")
    return joined.select("id", (F.coalesce("ni", F.lit(0)) > 1).alias("core"), F.col("no").isNull().alias("auxiliary"))


@query("""SELECT o_custkey AS seed, count(DISTINCT o_orderkey) + count(DISTINCT l_partkey) + 1 AS size, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line,
  CAST(1 + count(DISTINCT o_orderkey) + sum(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END) AS BIGINT) AS complexity
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey <= 50 GROUP BY o_custkey""")
def slice_info(spark: SparkSession, sf: str) -> DataFrame:
    """Size, line range and complexity of the slices of customers up to key 50, as its SQL has it; all: slice_info_all."""
    return _slice_info(v.table(spark, sf, "orders").filter("o_custkey <= 50"), v.table(spark, sf, "lineitem"))


@query("""SELECT o_custkey AS seed, count(DISTINCT o_orderkey) + count(DISTINCT l_partkey) + 1 AS size, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line,
  CAST(1 + count(DISTINCT o_orderkey) + sum(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END) AS BIGINT) AS complexity
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def slice_info_all(spark: SparkSession, sf: str) -> DataFrame:
    """Size, line range and complexity of each customer's slice."""
    return _slice_info(v.table(spark, sf, "orders"), v.table(spark, sf, "lineitem"))


def _slice_info(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    joined = orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    returned = F.sum(F.when(F.col("l_returnflag") == "R", 2).otherwise(0))
    return joined.groupBy(F.col("o_custkey").alias("seed")).agg(
        (F.countDistinct("o_orderkey") + F.countDistinct("l_partkey") + 1).alias("size"), F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"),
        (1 + F.countDistinct("o_orderkey") + returned).alias("complexity"),
    )


@query("""WITH d AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS defined, max(ts) AS last_use FROM events GROUP BY user_id)
SELECT e.user_id, count(*) FILTER (WHERE d.defined IS NULL OR e.ts < d.defined) AS undefined_uses, bool_or(d.defined IS NOT NULL AND d.defined = d.last_use) AS unused
FROM events e JOIN d USING (user_id) GROUP BY e.user_id""")
def undefined_unused(spark: SparkSession, sf: str) -> DataFrame:
    """Uses before the first definition and definitions without a later use, for each user (P10)."""
    e = v.table(spark, sf, "events")
    user = Window.partitionBy("user_id")
    e = e.withColumns({"defined": F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).over(user), "last_use": F.max("ts").over(user)})
    early = F.col("defined").isNull() | (F.col("ts") < F.col("defined"))
    return e.groupBy("user_id").agg(F.count_if(early).alias("undefined_uses"), F.bool_or(F.coalesce(F.col("defined") == F.col("last_use"), F.lit(False))).alias("unused"))


@query("SELECT l_orderkey AS def, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS uses FROM lineitem WHERE l_orderkey <= 1000 GROUP BY ALL")
def def_use_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Uses of definitions up to key 1000 in order, as its SQL has it; all: def_use_chains_all."""
    return _def_use_chains(v.table(spark, sf, "lineitem").filter("l_orderkey <= 1000"))


@query("SELECT l_orderkey AS def, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS uses FROM lineitem GROUP BY ALL")
def def_use_chains_all(spark: SparkSession, sf: str) -> DataFrame:
    """Uses of each definition in order."""
    return _def_use_chains(v.table(spark, sf, "lineitem"))


def _def_use_chains(line: DataFrame) -> DataFrame:
    uses = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return line.groupBy(F.col("l_orderkey").alias("def")).agg(F.array_join(F.transform(uses, lambda x: x["l_partkey"].cast("string")), ",").alias("uses"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reaching
FROM events""")
def reaching_definition(spark: SparkSession, sf: str) -> DataFrame:
    """The last definition before each use."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return v.table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w).alias("reaching"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_retailprice AS price FROM part a JOIN part b ON a.p_retailprice = b.p_retailprice AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey""")
def duplicate_constants(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of equal constants of one brand."""
    p = v.table(spark, sf, "part")
    x, y = (p.select(F.col("p_partkey").alias(k), F.col("p_retailprice").alias(f"price_{k}"), F.col("p_brand").alias(f"brand_{k}")) for k in ("a", "b"))
    joined = x.join(y, (F.col("price_a") == F.col("price_b")) & (F.col("brand_a") == F.col("brand_b")) & (F.col("a") < F.col("b")))
    return joined.select("a", "b", F.col("price_a").alias("price"))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995 AND month(o_orderdate) = 3)")
def dead_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an order in a month: an anti join."""
    used = v.table(spark, sf, "orders").filter("year(o_orderdate) = 1995 AND month(o_orderdate) = 3").select("o_custkey")
    return v.table(spark, sf, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query("SELECT l_suppkey AS id, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS lower_bound, min(l_quantity) FILTER (WHERE l_returnflag = 'A') AS upper_bound FROM lineitem GROUP BY l_suppkey")
def value_range(spark: SparkSession, sf: str) -> DataFrame:
    """Greatest lower and least upper bound of each key."""
    line = v.table(spark, sf, "lineitem")
    at = lambda f, flag: f(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    return line.groupBy(F.col("l_suppkey").alias("id")).agg(at(F.max, "R").alias("lower_bound"), at(F.min, "A").alias("upper_bound"))
