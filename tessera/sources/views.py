"""Relations over the driver tables that stand for code graphs, logs and findings, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str) -> Column:
    """`kind:key`, the id of a graph node."""
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def g_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """id, type, name, module, score of every element of the business graph."""
    t = lambda n: table(spark, sf, n)
    nation = t("nation")
    part = lambda df, kind, key, name, module, score: df.select(node_id(kind, key).alias("id"), F.lit(kind).alias("type"), name.alias("name"), module.alias("module"), score.cast("double").alias("score"))
    null = F.lit(None).cast("string")
    frames = [
        part(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "customer", "c_custkey", F.col("c_name"), F.col("n_name"), F.col("c_acctbal")),
        part(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "s_suppkey", F.col("s_name"), F.col("n_name"), F.col("s_acctbal")),
        part(t("part"), "part", "p_partkey", F.col("p_name"), F.col("p_brand"), F.col("p_retailprice")),
        part(nation, "nation", "n_nationkey", F.col("n_name"), null, F.lit(None)),
        part(t("region"), "region", "r_regionkey", F.col("r_name"), null, F.lit(None)),
        part(t("orders"), "order", "o_orderkey", null, F.col("o_orderstatus"), F.col("o_totalprice")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


G_NODES = """g_nodes AS (
  SELECT 'customer:' || c_custkey AS id, 'customer' AS type, c_name AS name, n_name AS module, CAST(c_acctbal AS DOUBLE) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, p_brand, p_retailprice FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, NULL, NULL FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name, NULL, NULL FROM region
  UNION ALL SELECT 'order:' || o_orderkey, 'order', NULL, o_orderstatus, o_totalprice FROM orders)"""


def g_edges(spark: SparkSession, sf: str) -> DataFrame:
    """from_id, to_id, type, confidence, weight."""
    t = lambda n: table(spark, sf, n)
    edge = lambda df, a, b, kind, conf=None, weight=None: df.select(node_id(*a).alias("from_id"), node_id(*b).alias("to_id"), F.lit(kind).alias("type"), (F.lit(1.0) if conf is None else conf).alias("confidence"), (F.lit(1.0) if weight is None else weight).alias("weight"))
    line = t("lineitem")
    frames = [
        edge(t("orders"), ("customer", "o_custkey"), ("order", "o_orderkey"), "placed"),
        edge(line, ("order", "l_orderkey"), ("part", "l_partkey"), "contains", F.round(1 - F.col("l_discount"), 2), F.col("l_quantity")),
        edge(line, ("order", "l_orderkey"), ("supplier", "l_suppkey"), "shipped_by"),
        edge(t("customer"), ("customer", "c_custkey"), ("nation", "c_nationkey"), "located_in"),
        edge(t("supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "located_in"),
        edge(t("nation"), ("nation", "n_nationkey"), ("region", "n_regionkey"), "part_of"),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


G_EDGES = """g_edges AS (
  SELECT 'customer:' || o_custkey AS from_id, 'order:' || o_orderkey AS to_id, 'placed' AS type, 1.0::DOUBLE AS confidence, 1.0::DOUBLE AS weight FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', round(1 - l_discount, 2), l_quantity FROM lineitem
  UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'shipped_by', 1.0, 1.0 FROM lineitem
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 1.0, 1.0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 1.0, 1.0 FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of', 1.0, 1.0 FROM nation)"""


def s_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Counts n of each event type followed by another one of the same user: a small cyclic graph."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select(F.col("event_type").alias("from_id"), F.lead("event_type").over(w).alias("to_id"))
    return e.filter("to_id IS NOT NULL").groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))


S_EDGES = """s_edges AS (
  SELECT from_id, to_id, count(*) AS n FROM (
    SELECT event_type AS from_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_id FROM events)
  WHERE to_id IS NOT NULL GROUP BY ALL)"""


def u_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The 64 strongest supplier-nation to customer-nation pairs: a cyclic graph of 25 nodes."""
    t = lambda n: table(spark, sf, n)
    joined = (
        t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    n = joined.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "src", "dst").limit(64)


U_EDGES = """u_edges AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY ALL ORDER BY n DESC, src, dst LIMIT 64)"""


def m_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Modules and their dependencies: a part depends on another one of its brand that follows it in an order. from_id, to_id, n,
    type, confidence; with cycles of many lengths at every scale. Part's keys and brands are small in the file and not in memory: shuffled."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("from_id"), F.lead("l_partkey").over(w).alias("to_id"), F.round(F.col("l_discount") * 100).cast("int").alias("doubt"))
    part = table(spark, sf, "part")
    a, b = (part.select(F.col("p_partkey").alias(k), F.col("p_brand").alias(f"{k}_brand")) for k in ("from_id", "to_id"))
    pairs = line.filter("from_id <> to_id").join(a.hint("merge"), "from_id").join(b.hint("merge"), "to_id").filter("from_id_brand = to_id_brand")
    kind = F.element_at(F.array(F.lit("call"), F.lit("import"), F.lit("inherit")), ((F.col("from_id") + F.col("to_id")) % 3 + 1).cast("int"))
    n = pairs.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doubt").alias("doubt"))
    return n.select("from_id", "to_id", "n", kind.alias("type"), ((100 * F.col("n") - F.col("doubt")).cast("double") / (100 * F.col("n"))).alias("confidence"))


M_EDGES = """m_edges AS (
  SELECT from_id, to_id, n, CASE (from_id + to_id) % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'import' ELSE 'inherit' END AS type, CAST(100 * n - doubt AS DOUBLE) / (100 * n) AS confidence FROM (
    SELECT from_id, to_id, count(*) AS n, sum(doubt) AS doubt FROM (
      SELECT l_partkey AS from_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS to_id,
        CAST(round(l_discount * 100) AS INTEGER) AS doubt FROM lineitem)
    JOIN part a ON a.p_partkey = from_id JOIN part b ON b.p_partkey = to_id
    WHERE from_id <> to_id AND a.p_brand = b.p_brand GROUP BY from_id, to_id))"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """request_id, tool, ts, ok and duration of each call in the audit log."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("user_id").alias("request_id"), F.col("event_type").alias("tool"), "ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration"))


CALLS = "calls AS (SELECT event_id, user_id AS request_id, event_type AS tool, ts, event_type <> 'error' AS ok, value AS duration FROM events)"


def gov(spark: SparkSession, sf: str) -> DataFrame:
    """Governance log: event_type, policy, severity and user of each event."""
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'OPERATION_ALLOWED' WHEN 'error' THEN 'POLICY_VIOLATION' WHEN 'signup' THEN 'OVERRIDE_REQUESTED' WHEN 'click' THEN 'OVERRIDE_APPROVED' ELSE 'OPERATION_READ' END")
    severity = F.expr("CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 50 THEN 'HIGH' WHEN value >= 20 THEN 'MEDIUM' ELSE 'LOW' END")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("event_id", "ts", kind.alias("event_type"), F.concat(F.lit("policy_"), (k % 7).cast("string")).alias("policy"), severity.alias("severity"), "user_id")


GOV = """gov AS (
  SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'OPERATION_ALLOWED' WHEN 'error' THEN 'POLICY_VIOLATION' WHEN 'signup' THEN 'OVERRIDE_REQUESTED' WHEN 'click' THEN 'OVERRIDE_APPROVED' ELSE 'OPERATION_READ' END AS event_type,
    'policy_' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 7) AS policy,
    CASE WHEN value >= 100 THEN 'CRITICAL' WHEN value >= 50 THEN 'HIGH' WHEN value >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity, user_id
  FROM events)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, pos (from 1) and line of each non-blank line of documents."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return d.filter(F.trim("line") != "").select("doc_id", (F.col("p") + 1).alias("pos"), "line")


LINES = """lines AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE trim(line) <> '')"""


def hrefs(spark: SparkSession, sf: str) -> DataFrame:
    """page_id and target of each link."""
    p = table(spark, sf, "pages")
    return p.select("page_id", F.explode(F.expr("regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)")).alias("href"))


HREFS = """hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)"""


#: One generated Python file for each part; the text is SQL that both engines read, as it makes input data and no result.
_SOURCE_TEXT = """'from pkg_' || ((p_partkey * 3 + 1) % 10) || ' import helper_' || (p_size % 5) || chr(10)
 || CASE WHEN p_partkey % 23 = 0 THEN 'def Bad' ELSE 'def ' || CASE WHEN p_partkey % 6 = 0 THEN '_' ELSE '' END END || replace(p_name, ' ', '_') || '_' || p_partkey || '(self, item: int, limit=10' || CASE WHEN p_size % 7 = 0 THEN ', a=1, b=2, c=3' ELSE '' END || '):' || chr(10)
 || CASE WHEN p_partkey % 3 > 0 THEN '    \"\"\"' || p_type || ' of ' || p_brand || ' in a line that says a good deal more than it would have to\"\"\"' || chr(10) ELSE '' END
 || '    total = ' || p_size || chr(10)
 || CASE WHEN p_partkey % 5 = 0 THEN '    unused = 1  # TODO remove' || chr(10) ELSE '' END
 || CASE WHEN p_partkey % 11 = 0 THEN '    total = eval(item)' || chr(10) ELSE '' END
 || CASE WHEN p_partkey % 13 = 0 THEN '    total = random.random()' || chr(10) ELSE '' END
 || CASE WHEN p_partkey % 17 = 0 THEN '    print(password)' || chr(10) ELSE '' END
 || CASE WHEN p_size % 4 > 0 THEN '    if item > 1 and limit:' || chr(10) ELSE '' END
 || CASE WHEN p_size % 4 > 1 THEN '        for n in range(item):' || chr(10) ELSE '' END
 || CASE WHEN p_size % 4 > 2 THEN '            while total > 3 or n:' || chr(10) ELSE '' END
 || repeat(' ', CAST(4 * (p_size % 4 + 1) AS INT)) || 'total = helper_' || (p_size % 5) || '(total, item)' || chr(10)
 || '    return total'
 || CASE WHEN p_partkey % 19 = 0 THEN chr(10) || '    total = 0' ELSE '' END"""
_SOURCE_PATH = "CASE WHEN p_partkey % 10 = 9 THEN 'tests/' ELSE 'pkg_' || (p_partkey % 10) || '/' END || replace(p_name, ' ', '_') || '_' || p_partkey || '.py'"


def src(spark: SparkSession, sf: str) -> DataFrame:
    """file_id, path and code of each generated source file; dealt out by file first, as a small table makes many lines."""
    part = table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return part.select(F.col("p_partkey").alias("file_id"), F.expr(_SOURCE_PATH).alias("path"), F.expr(_SOURCE_TEXT).alias("code"))


SRC = f"src AS (SELECT p_partkey AS file_id, {_SOURCE_PATH} AS path, {_SOURCE_TEXT} AS code FROM part)"


def src_lines(spark: SparkSession, sf: str) -> DataFrame:
    """file_id, path, pos (from 1), line and indent (in steps of four) of each line of the sources."""
    d = src(spark, sf).select("file_id", "path", F.posexplode(F.split("code", "\n")).alias("p", "line"))
    return d.select("file_id", "path", (F.col("p") + 1).alias("pos"), "line", ((F.length("line") - F.length(F.ltrim("line"))) / 4).cast("int").alias("indent"))


SRC_LINES = f"""{SRC}, src_lines AS (
  SELECT file_id, path, CAST(pos AS INTEGER) AS pos, line, CAST((length(line) - length(ltrim(line))) // 4 AS INTEGER) AS indent FROM (
    SELECT file_id, path, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1) AS pos FROM src))"""
