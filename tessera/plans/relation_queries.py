"""Queries over graph neighbourhoods, metrics of nodes, schema and contract changes, risk rules and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import graph as g
from tessera.plans.registry import query
from tessera.sources import views as v


@query(f"WITH {v.G_EDGES} SELECT from_id, to_id, type, CASE WHEN from_id = 'nation:3' THEN 'out' ELSE 'in' END AS direction FROM g_edges WHERE from_id = 'nation:3' OR to_id = 'nation:3'")
def edges_of_node(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from and to one node (G15): a point filter that reaches the scans."""
    e = v.g_edges(spark, sf).filter((F.col("from_id") == "nation:3") | (F.col("to_id") == "nation:3"))
    return e.select("from_id", "to_id", "type", F.when(F.col("from_id") == "nation:3", "out").otherwise("in").alias("direction"))


@query("""WITH n AS (SELECT event_type || ':' || user_id AS id, event_id, value FROM events)
SELECT id, arg_min(value, event_id) AS value, count(*) AS inserted FROM n GROUP BY id""")
def node_insert_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Of nodes inserted several times the first stays; edges would all stay."""
    n = v.table(spark, sf, "events").select(F.concat_ws(":", "event_type", "user_id").alias("id"), "event_id", "value")
    return n.groupBy("id").agg(F.min_by("value", "event_id").alias("value"), F.count(F.lit(1)).alias("inserted"))


@query(f"WITH {v.G_NODES} SELECT id, score FROM g_nodes WHERE type = 'supplier' AND length(name) % 2 = 0 AND (score < 0 OR score > 5000)")
def select_by_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by a free predicate, given as a column expression, with OR."""
    rule = (F.length("name") % 2 == 0) & ((F.col("score") < 0) | (F.col("score") > 5000))
    return v.g_nodes(spark, sf).filter((F.col("type") == "supplier") & rule).select("id", "score")


@query(f"""WITH {v.G_EDGES}, f AS (SELECT id FROM (VALUES ('nation:1'), ('nation:2'), ('customer:5')) s(id))
SELECT from_id, to_id, type FROM g_edges WHERE from_id IN (SELECT id FROM f) OR to_id IN (SELECT id FROM f)""")
def focus_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with an end in the focus set (T16): one pass with a list that the scans can use."""
    focus = ("nation:1", "nation:2", "customer:5")
    return v.g_edges(spark, sf).filter(F.col("from_id").isin(*focus) | F.col("to_id").isin(*focus)).select("from_id", "to_id", "type")


@query(f"""WITH RECURSIVE {v.G_EDGES}, up AS (SELECT 'region:1' AS id, 0 AS depth UNION SELECT e.from_id, up.depth + 1 FROM up JOIN g_edges e ON e.to_id = up.id)
SELECT split_part(id, ':', 1) AS kind, CAST(min(depth) AS INTEGER) AS nearest, count(DISTINCT id) AS n FROM up GROUP BY kind""")
def transitive_dependents(spark: SparkSession, sf: str) -> DataFrame:
    """All that depends on a region, however far, by kind."""
    near = g.closure(v.g_edges(spark, sf), spark.createDataFrame([("region:1",)], "id string"), "in")
    return near.groupBy(F.split_part("id", F.lit(":"), F.lit(1)).alias("kind")).agg(F.min("depth").alias("nearest"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {v.S_EDGES}, walk AS (SELECT [from_id, to_id] AS path FROM s_edges WHERE from_id = 'signup' UNION ALL
  SELECT list_append(w.path, e.to_id) FROM walk w JOIN s_edges e ON e.from_id = w.path[-1] WHERE len(w.path) < 4)
SELECT array_to_string(path, '>') AS chain, CAST(len(path) - 1 AS INTEGER) AS depth FROM walk ORDER BY depth, chain LIMIT 25""")
def dependency_chains(spark: SparkSession, sf: str) -> DataFrame:
    """The first 25 chains from one node, by breadth, of up to three edges, without a guard against cycles."""
    e = v.s_edges(spark, sf)
    level = e.filter("from_id = 'signup'").select(F.array("from_id", "to_id").alias("path"))
    out = level
    for _ in range(2):
        level = level.join(e, F.element_at("path", -1) == F.col("from_id")).select(F.concat("path", F.array("to_id")).alias("path"))
        out = out.unionByName(level)
    chain = out.select(F.array_join("path", ">").alias("chain"), (F.size("path") - 1).alias("depth"))
    return chain.orderBy("depth", "chain").limit(25)


@query(f"""WITH RECURSIVE {v.G_EDGES}, d AS (SELECT 'customer:2' AS id UNION SELECT e.to_id FROM d JOIN g_edges e ON e.from_id = d.id),
u AS (SELECT 'region:1' AS id UNION SELECT e.from_id FROM u JOIN g_edges e ON e.to_id = u.id),
b AS (SELECT id FROM d INTERSECT SELECT id FROM u)
SELECT DISTINCT from_id, to_id FROM g_edges WHERE from_id IN (SELECT id FROM b) AND to_id IN (SELECT id FROM b)""")
def subgraph_between(spark: SparkSession, sf: str) -> DataFrame:
    """Edges on ways from a customer to a region."""
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    return g.between(v.g_edges(spark, sf), one("customer:2"), one("region:1")).select("from_id", "to_id").distinct()


@query(f"""WITH {v.G_EDGES}, e AS (SELECT to_id AS id, type, 0 AS o FROM g_edges UNION ALL SELECT from_id, type, 1 FROM g_edges)
SELECT id, count(*) FILTER (WHERE o = 0) AS n_in, count(*) FILTER (WHERE o = 1) AS n_out, count(*) FILTER (WHERE o = 0 AND type = 'located_in') AS located_in, count(*) FILTER (WHERE o = 0 AND type = 'shipped_by') AS shipped_by,
  count(DISTINCT type) AS kinds FROM e GROUP BY id""")
def dependency_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees and counts of edge types of each node (T24, T25): one aggregate over both ends."""
    e = v.g_edges(spark, sf)
    both = e.select(F.col("to_id").alias("id"), "type", F.lit(0).alias("o")).unionByName(e.select(F.col("from_id").alias("id"), "type", F.lit(1).alias("o")))
    into = lambda t: F.count_if((F.col("o") == 0) & (F.col("type") == t))
    return both.groupBy("id").agg(F.count_if(F.col("o") == 0).alias("n_in"), F.count_if(F.col("o") == 1).alias("n_out"), into("located_in").alias("located_in"), into("shipped_by").alias("shipped_by"), F.countDistinct("type").alias("kinds"))


@query(f"""WITH RECURSIVE {v.G_EDGES}, up AS (SELECT 'nation:4' AS id, ['nation:4'] AS path UNION ALL SELECT e.from_id, list_prepend(e.from_id, up.path) FROM up JOIN (SELECT DISTINCT from_id, to_id FROM g_edges) e ON e.to_id = up.id WHERE len(up.path) < 4)
SELECT id, array_to_string(arg_min(path, array_to_string(path, '>')), '>') AS chain, CAST(len(path) - 1 AS INTEGER) AS hops FROM up WHERE len(path) > 1 AND split_part(id, ':', 1) <> 'order' GROUP BY id, len(path)""")
def call_chains_to(spark: SparkSession, sf: str) -> DataFrame:
    """The first shortest chain from each direct or remote caller to one target, of fewer than four nodes."""
    e = v.g_edges(spark, sf).select("from_id", "to_id")
    level = spark.createDataFrame([("nation:4", "nation:4")], "id string, chain string")
    out = None
    for hops in range(1, 4):
        near = level.join(e, F.col("id") == F.col("to_id")).select(F.col("from_id").alias("id"), F.concat_ws(">", "from_id", "chain").alias("chain"))
        level = near.groupBy("id").agg(F.min("chain").alias("chain"))
        own = level.filter("NOT startswith(id, 'order:')").withColumn("hops", F.lit(hops))
        out = own if out is None else out.unionByName(own)
    return out.select("id", "chain", "hops")


@query(f"""WITH {v.G_EDGES}, l(id, level) AS (VALUES ('customer', 0), ('supplier', 0), ('nation', 1), ('region', 2)) SELECT split_part(e.from_id, ':', 1) AS kind, count(DISTINCT e.from_id) AS n, max(l.level) AS level
FROM g_edges e JOIN l ON l.id = split_part(e.from_id, ':', 1) WHERE e.type IN ('located_in', 'part_of') GROUP BY ALL
UNION ALL SELECT 'region', count(DISTINCT 'region:' || n_regionkey), 2 FROM nation""")
def longest_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the location graph by the length of the longest way to them."""
    found = g.levels(g.filter_edges(v.g_edges(spark, sf), ("located_in", "part_of")))
    return found.groupBy(F.split_part("id", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("level"))


@query("""WITH r AS (SELECT l_partkey AS symbol, l_orderkey AS file, l_linenumber AS line, l_linenumber = 1 AS is_definition FROM lineitem)
SELECT symbol, file, line, is_definition, row_number() OVER (PARTITION BY symbol ORDER BY is_definition DESC, file, line) AS place FROM r QUALIFY place <= 3""")
def reference_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first three references of each symbol: definitions first, then by file and line."""
    r = v.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") == 1).alias("is_definition"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("is_definition"), "file", "line"))
    return r.withColumn("place", place.cast("long")).filter("place <= 3")


@query(f"""WITH {v.GOV} SELECT event_id, severity, policy FROM gov WHERE event_type = 'POLICY_VIOLATION'
ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, event_id LIMIT 100""")
def findings_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred most urgent findings."""
    rank = F.array_position(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))), F.col("severity"))
    found = v.gov(spark, sf).filter("event_type = 'POLICY_VIOLATION'")
    return found.orderBy(rank, "event_id").limit(100).select("event_id", "severity", "policy")


@query("""WITH s AS (SELECT l_partkey AS id, sum(l_extendedprice) AS impact, count(*) AS effort FROM lineitem GROUP BY 1)
SELECT id, round(impact, 2) AS impact, effort FROM s ORDER BY round(impact, 2) DESC, effort DESC, id LIMIT 20""")
def refactoring_priority(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty candidates of the greatest impact, then effort."""
    s = v.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("impact"), F.count(F.lit(1)).alias("effort"))
    return s.orderBy(F.desc("impact"), F.desc("effort"), "id").limit(20)


@query("""WITH i AS (SELECT user_id, event_type = 'error' AS stale FROM events)
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE stale) AS stale, round(1 - count(*) FILTER (WHERE stale) / greatest(count(*), 1), 6) AS hit_rate FROM i GROUP BY user_id""")
def index_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Entries, stale ones and hit rate of each index."""
    e = v.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("stale"))
    return e.withColumn("hit_rate", F.round(1 - F.col("stale") / F.greatest("total", F.lit(1)), 6))


@query("""SELECT event_type AS method, CASE WHEN user_id % 4 = 0 THEN 'unary' WHEN user_id % 4 = 1 THEN 'server_stream' WHEN user_id % 4 = 2 THEN 'client_stream' ELSE 'bidirectional' END AS kind, count(*) AS n FROM events GROUP BY ALL""")
def streaming_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by method and kind of streaming, derived from two flags."""
    client, server = F.col("user_id") % 4 >= 2, F.col("user_id") % 2 == 1
    kind = F.when(client & server, "bidirectional").when(client, "client_stream").when(server, "server_stream").otherwise("unary")
    return v.table(spark, sf, "events").groupBy(F.col("event_type").alias("method"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {v.GOV} SELECT policy AS tool, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low FROM gov GROUP BY policy""")
def findings_by_tool(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of each tool by severity, side by side (A27): one pivot with known values."""
    p = v.gov(spark, sf).groupBy(F.col("policy").alias("tool")).pivot("severity", ["CRITICAL", "HIGH", "MEDIUM", "LOW"]).agg(F.count(F.lit(1)))
    return p.select("tool", *(F.coalesce(c, F.lit(0).cast("long")).alias(c.lower()) for c in ("CRITICAL", "HIGH", "MEDIUM", "LOW")))


@query("""WITH a AS (SELECT 'part.' || p_brand || '.' || p_type AS path, max(p_size) AS kind FROM part WHERE p_partkey % 3 > 0 GROUP BY 1), b AS (SELECT 'part.' || p_brand || '.' || p_type AS path, max(p_size) AS kind FROM part WHERE p_partkey % 3 < 2 GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'type_changed' END AS change, b.path IS NULL OR a.path IS NOT NULL AS breaking
FROM a FULL JOIN b ON a.path = b.path WHERE a.kind IS DISTINCT FROM b.kind""")
def schema_paths_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between two flattened nested schemas: added, removed and changed paths, and whether they break."""
    flat = lambda keep: v.table(spark, sf, "part").filter(keep).groupBy(F.concat_ws(".", F.lit("part"), "p_brand", "p_type").alias("path")).agg(F.max("p_size").alias("kind"))
    a, b = flat("p_partkey % 3 > 0").alias("a"), flat("p_partkey % 3 < 2").alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full").filter(~F.col("a.kind").eqNullSafe(F.col("b.kind")))
    change = F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "removed").otherwise("type_changed")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change")).withColumn("breaking", F.col("change") != "added")


@query("""WITH s AS (SELECT s_nationkey AS nation, list_distinct(list(p_brand)) AS brands FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 3 GROUP BY 1)
SELECT a.nation AS a, b.nation AS b, CAST(len(list_intersect(a.brands, b.brands)) AS INTEGER) AS shared, CAST(len(a.brands) - len(list_intersect(a.brands, b.brands)) AS INTEGER) AS only_a, CAST(len(b.brands) - len(list_intersect(a.brands, b.brands)) AS INTEGER) AS only_b
FROM s a JOIN s b ON b.nation = a.nation + 1""")
def shared_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Shared and own members of the sets of neighbouring nations (D11); a set has at most as many members as there are brands."""
    t = lambda n: v.table(spark, sf, n)
    s = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part").filter("p_size <= 3"), F.col("l_partkey") == F.col("p_partkey"))
    a = s.groupBy(F.col("s_nationkey").alias("a")).agg(F.collect_set("p_brand").alias("x"))
    both = a.join(a.select((F.col("a") - 1).alias("before"), F.col("a").alias("b"), F.col("x").alias("y")), F.col("a") == F.col("before"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("shared"), (F.size("x") - shared).alias("only_a"), (F.size("y") - shared).alias("only_b"))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(url, '^https?://[^/]+', '')), '[?#].*$', ''), '/[0-9]+', '/{id}', 'g') AS path FROM pages)
SELECT page_id, CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS route FROM p""")
def route_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Routes of URLs: no host, query or trailing slash, numbers as a parameter."""
    path = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace("url", "^https?://[^/]+", "")), "[?#].*$", ""), "/[0-9]+", "/{id}")
    bare = F.regexp_replace(path, "/+$", "")
    return v.table(spark, sf, "pages").select("page_id", F.when(bare == "", "/").otherwise(bare).alias("route"))


@query("""WITH x AS (SELECT p_partkey AS id, [p_size // 10, p_size % 10, p_partkey % 4] AS have FROM part) SELECT id, have >= [2, 4, 1] AS at_least FROM x""")
def version_at_least(spark: SparkSession, sf: str) -> DataFrame:
    """Versions not below 2.4.1, compared number by number."""
    text = F.concat_ws(".", F.floor(F.col("p_size") / 10), F.col("p_size") % 10, F.col("p_partkey") % 4)
    have = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (have >= F.array(F.lit(2), F.lit(4), F.lit(1))).alias("at_least"))


_LICENSES = ("MIT License", "Apache 2.0", "GPL-3.0", "AGPL v3", "LGPL-2.1", "BSD 3-Clause", "proprietary")


@query("""WITH l AS (SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'MIT License' WHEN 1 THEN 'Apache 2.0' WHEN 2 THEN 'GPL-3.0' WHEN 3 THEN 'AGPL v3' WHEN 4 THEN 'LGPL-2.1' WHEN 5 THEN 'BSD 3-Clause' ELSE 'proprietary' END AS license FROM part)
SELECT license, CASE license WHEN 'GPL-3.0' THEN 'high' WHEN 'AGPL v3' THEN 'high' WHEN 'LGPL-2.1' THEN 'medium' WHEN 'proprietary' THEN 'unknown' ELSE 'low' END AS risk, count(*) AS packages FROM l GROUP BY ALL""")
def license_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Packages by license and its risk: strong copyleft, weak copyleft, permissive."""
    own = F.element_at(F.array(*map(F.lit, _LICENSES)), (F.col("p_partkey") % 7 + 1).cast("int"))
    weak, strong, free = own.rlike("(?i)^LGPL|MPL|EPL"), own.rlike("(?i)^A?GPL"), own.rlike("(?i)MIT|Apache|BSD|ISC")
    risk = F.when(strong, "high").when(weak, "medium").when(free, "low").otherwise("unknown")
    return v.table(spark, sf, "part").groupBy(own.alias("license"), risk.alias("risk")).agg(F.count(F.lit(1)).alias("packages"))


@query("""WITH o AS (SELECT p_partkey AS id, (p_size * 2) / 10.0 AS cvss, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS fixed FROM part)
SELECT id, CASE WHEN cvss >= 9 THEN 'CRITICAL' WHEN cvss >= 7 THEN 'HIGH' WHEN cvss >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, '1.' || fixed AS fixed FROM o""")
def advisory_severity(spark: SparkSession, sf: str) -> DataFrame:
    """Severity by score and the first fixed version out of an advisory in JSON."""
    fixed = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("1."), F.col("p_size").cast("string")))
    doc = F.to_json(F.struct((F.col("p_size") * 2 / 10.0).alias("cvss"), F.array(F.struct(fixed.alias("fixed"))).alias("events")))
    a = v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.from_json(doc, "cvss double, events array<struct<fixed: string>>").alias("a"))
    score = F.col("a.cvss")
    level = F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")
    return a.select("id", level.alias("severity"), F.col("a.events")[0]["fixed"].alias("fixed"))


@query(f"""WITH {v.G_EDGES}, r(source, target, rule) AS (VALUES ('customer', 'supplier', 'no_direct_supply'), ('order', 'supplier', 'ship_through_parts'), ('supplier', 'nation', 'no_location'))
SELECT rule, count(*) AS violations, count(DISTINCT from_id) AS sources FROM g_edges JOIN r ON split_part(from_id, ':', 1) = source AND split_part(to_id, ':', 1) = target GROUP BY rule""")
def topology_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that a topology rule forbids between two kinds of nodes (R6): rules are a table of fixed size, sent to all."""
    rules = spark.createDataFrame([("customer", "supplier", "no_direct_supply"), ("order", "supplier", "ship_through_parts"), ("supplier", "nation", "no_location")], "source string, target string, rule string")
    kind = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    found = v.g_edges(spark, sf).join(F.broadcast(rules), (kind("from_id") == F.col("source")) & (kind("to_id") == F.col("target")))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"), F.countDistinct("from_id").alias("sources"))


@query("""WITH f AS (SELECT page_id, html, url FROM pages) SELECT page_id, regexp_matches(substr(coalesce(html, ''), 1, 300), '(?i)generat|do not edit|auto-?gen') AS generated,
  CAST((CASE WHEN contains(url, 'index') THEN 3 ELSE 0 END) + least(5, length(coalesce(html, '')) // 2000) + (CASE WHEN contains(url, '?') THEN -1 ELSE 0 END) AS BIGINT) AS importance FROM f""")
def file_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Generated files by their first characters, and an importance by name and size."""
    text = F.coalesce("html", F.lit(""))
    score = F.when(F.col("url").contains("index"), 3).otherwise(0) + F.least(F.lit(5), F.floor(F.length(text) / 2000)) - F.when(F.col("url").contains("?"), 1).otherwise(0)
    return v.table(spark, sf, "pages").select("page_id", F.substring(text, 1, 300).rlike("(?i)generat|do not edit|auto-?gen").alias("generated"), score.cast("long").alias("importance"))


@query("""WITH s AS (SELECT DISTINCT p_brand AS module, p_type AS symbol, p_partkey % 5 = 0 AS listed FROM part), l AS (SELECT module FROM s GROUP BY module HAVING bool_or(listed AND symbol LIKE 'P%'))
SELECT s.module, s.symbol FROM s WHERE CASE WHEN module IN (SELECT module FROM l) THEN listed AND symbol LIKE 'P%' ELSE symbol NOT LIKE 'S%' END GROUP BY ALL""")
def wildcard_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """What `import *` brings from each module: the listed names if it has a list, else the public ones."""
    s = v.table(spark, sf, "part").select(F.col("p_brand").alias("module"), F.col("p_type").alias("symbol"), ((F.col("p_partkey") % 5 == 0) & F.col("p_type").startswith("P")).alias("listed"))
    m = s.groupBy("module").agg(F.collect_set(F.when(F.col("listed"), F.col("symbol"))).alias("all"), F.collect_set(F.when(~F.col("symbol").startswith("S"), F.col("symbol"))).alias("public"))
    return m.select("module", F.explode(F.when(F.size("all") > 0, F.col("all")).otherwise(F.col("public"))).alias("symbol"))
