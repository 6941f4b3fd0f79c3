"""Text, rule, taint and metric queries of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.registry import query
from tessera.sources import views as v

#: kind, pattern, severity, CWE of the scan rules.
RULES = (
    ("license", "[Ll]icense", "LOW", 1104),
    ("ip_address", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "MEDIUM", 200),
    ("long_number", "[0-9]{12,}", "HIGH", 359),
    ("email", "[A-Za-z0-9.]+@[A-Za-z0-9]+[.][A-Za-z]+", "MEDIUM", 359),
    ("token", "token", "CRITICAL", 798),
)
RULE_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{p}', '{s}', {c})" for k, p, s, c in RULES) + ") r(kind, pattern, severity, cwe))"
HITS = f"{v.LINES}, {RULE_SQL}, hits AS (SELECT doc_id, pos, kind, severity, cwe FROM lines JOIN rules ON regexp_matches(line, pattern))"


def scan(lines: DataFrame, rules: tuple[tuple[str, str, str, int], ...] = RULES) -> DataFrame:
    """One row for each line and rule that matches it: the rules are tried in one pass over the lines, without a join."""
    hit = [F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(c).alias("cwe"))) for k, p, s, c in rules]
    found = lines.select("doc_id", "pos", "line", F.explode(F.array_compact(F.array(*hit))).alias("hit"))
    return found.select("doc_id", "pos", "line", "hit.*")


@query(f"WITH {HITS} SELECT kind, severity, count(*) AS hits, count(DISTINCT doc_id) AS files FROM hits GROUP BY ALL")
def sink_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rule hits over all lines."""
    return scan(v.lines(spark, sf)).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("files"))


@query(f"WITH {v.LINES} SELECT doc_id, pos, CAST(position('token' IN line) AS INTEGER) AS at, substr(line, 1, 40) AS snippet FROM lines WHERE contains(line, 'token')")
def sink_scan_snippet(spark: SparkSession, sf: str) -> DataFrame:
    """Place and beginning of each line with a literal pattern."""
    return v.lines(spark, sf).filter(F.col("line").contains("token")).select("doc_id", "pos", F.instr("line", "token").alias("at"), F.substring("line", 1, 40).alias("snippet"))


@query(f"""WITH {v.LINES} SELECT doc_id, pos, regexp_extract(line, '(token|password) ?= ?"?([A-Za-z0-9]+)', 1) AS kind, CAST(length(regexp_extract(line, '(token|password) ?= ?"?([A-Za-z0-9]+)', 2)) AS INTEGER) AS size
FROM lines WHERE regexp_matches(line, '(token|password) ?= ?"?([A-Za-z0-9]+)')""")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Assigned secrets, by kind and size."""
    pattern = '(token|password) ?= ?"?([A-Za-z0-9]+)'
    part = lambda n: F.regexp_extract("line", pattern, n)
    return v.lines(spark, sf).filter(F.col("line").rlike(pattern)).select("doc_id", "pos", part(1).alias("kind"), F.length(part(2)).alias("size"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]{12,}')) AS INTEGER) AS numbers, CAST(length(regexp_replace(text, '[0-9]{12,}', '[NUMBER]', 'g')) AS INTEGER) AS redacted_chars
FROM documents WHERE regexp_matches(text, '[0-9]{12,}')""")
def redaction_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted numbers and the length that is left."""
    d = v.table(spark, sf, "documents").filter(F.col("text").rlike("[0-9]{12,}"))
    return d.select("doc_id", F.regexp_count("text", F.lit("[0-9]{12,}")).alias("numbers"), F.length(F.regexp_replace("text", "[0-9]{12,}", "[NUMBER]")).alias("redacted_chars"))


@query(f"""WITH {HITS}, owasp AS (SELECT * FROM (VALUES (359, 'A02'), (798, 'A07'), (200, 'A01'), (79, 'A03')) o(cwe, category))
SELECT category, count(kind) AS findings, count(kind) > 0 AS covered FROM owasp LEFT JOIN hits USING (cwe) GROUP BY category""")
def owasp_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Categories and how many findings fall into each."""
    owasp = spark.createDataFrame([(359, "A02"), (798, "A07"), (200, "A01"), (79, "A03")], "cwe int, category string")
    hits = scan(v.lines(spark, sf)).groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))
    j = owasp.join(hits, "cwe", "left").groupBy("category").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))
    return j.withColumn("covered", F.col("findings") > 0)


@query(f"""WITH {HITS} SELECT CASE WHEN cwe IN (359, 200) THEN 'GDPR' WHEN cwe = 798 THEN 'SOC2' ELSE 'NONE' END AS standard, count(*) AS findings, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS serious FROM hits GROUP BY ALL""")
def compliance_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by standard."""
    standard = F.when(F.col("cwe").isin(359, 200), "GDPR").when(F.col("cwe") == 798, "SOC2").otherwise("NONE")
    return scan(v.lines(spark, sf)).groupBy(standard.alias("standard")).agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("serious"))


WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 ELSE 1 END"


@query(f"WITH {HITS}, d AS (SELECT doc_id, count(*) AS violations, CAST(greatest(0, 100 - sum({WEIGHT})) AS BIGINT) AS score FROM hits GROUP BY doc_id) SELECT score >= 80 AS passed, count(*) AS files, CAST(sum(violations) AS BIGINT) AS violations FROM d GROUP BY ALL")
def policy_check_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Files that pass the policy check."""
    d = scan(v.lines(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("violations"), F.greatest(F.lit(0), 100 - F.sum(F.expr(WEIGHT))).alias("score"))
    return d.groupBy((F.col("score") >= 80).alias("passed")).agg(F.count(F.lit(1)).alias("files"), F.sum("violations").alias("violations"))


@query("""SELECT user_id AS key, CAST(min(CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) AS INTEGER) AS level, count(DISTINCT event_type) AS sources,
  bool_and(event_type <> 'error') AS cleared FROM events GROUP BY user_id""")
def taint_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Merge of several sources: most tainted level, cleared only if all are."""
    level = F.expr("CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END")
    return v.table(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.min(level).alias("level"), F.countDistinct("event_type").alias("sources"), F.every(F.col("event_type") != "error").alias("cleared"))


SINKS = "CASE p_brand WHEN 'Brand#11' THEN 'SQL' WHEN 'Brand#22' THEN 'SHELL' WHEN 'Brand#33' THEN 'FILE' ELSE 'NETWORK' END"
SEVERITY = "CASE sink WHEN 'SQL' THEN 'HIGH' WHEN 'SHELL' THEN 'HIGH' WHEN 'FILE' THEN 'MEDIUM' ELSE 'LOW' END"
CWE = "CASE sink WHEN 'SQL' THEN 89 WHEN 'SHELL' THEN 78 WHEN 'FILE' THEN 22 ELSE 918 END"


@query(f"""WITH f AS (SELECT DISTINCT o_custkey AS source, {SINKS} AS sink, l_linenumber AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')
SELECT sink, {SEVERITY} AS severity, {CWE} AS cwe, count(*) AS flows FROM f GROUP BY ALL""")
def taint_flows_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct flows by sink with severity and CWE."""
    t = lambda n: v.table(spark, sf, n)
    j = t("lineitem").filter("l_returnflag = 'R'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    f = j.select(F.col("o_custkey").alias("source"), F.expr(SINKS).alias("sink"), F.col("l_linenumber").alias("line")).distinct()
    return f.groupBy("sink").agg(F.count(F.lit(1)).alias("flows")).select("sink", F.expr(SEVERITY).alias("severity"), F.expr(CWE).alias("cwe"), "flows")


BASE = "CASE kind WHEN 'token' THEN 0.95 WHEN 'long_number' THEN 0.9 WHEN 'email' THEN 0.8 ELSE 0.7 END"


@query(f"""WITH {HITS}, c AS (SELECT kind, pos, round(least(1.0, {BASE} * CASE WHEN pos <= 1 THEN 1.1 WHEN pos <= 3 THEN 1.0 ELSE greatest(0.7, 1 - 0.05 * pos) END), 6) AS confidence FROM hits)
SELECT kind, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(confidence), 4) AS mean FROM c GROUP BY ALL""")
def vuln_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of findings by base and length of flow."""
    flow = F.expr("CASE WHEN pos <= 1 THEN 1.1 WHEN pos <= 3 THEN 1.0 ELSE greatest(0.7D, 1 - 0.05 * pos) END").cast("double")
    c = scan(v.lines(spark, sf)).withColumn("confidence", F.round(F.least(F.lit(1.0), F.expr(BASE).cast("double") * flow), 6))
    band = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    return c.groupBy("kind", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean"))


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS words, len(regexp_extract_all(text, '[.,;:!?]')) AS operators FROM documents),
m AS (SELECT doc_id, len(words) AS n2, len(list_distinct(words)) AS u2, operators AS n1 FROM t)
SELECT doc_id, CAST(n1 + n2 AS BIGINT) AS length, round((n1 + n2) * log2(u2 + 6), 4) AS volume, round(6.0 / 2 * n2 / greatest(u2, 1), 4) AS difficulty FROM m""")
def halstead_text(spark: SparkSession, sf: str) -> DataFrame:
    """Length, volume and difficulty with words as operands and punctuation as operators."""
    words = F.split("text", " ")
    m = v.table(spark, sf, "documents").select("doc_id", F.size(words).alias("n2"), F.size(F.array_distinct(words)).alias("u2"), F.regexp_count("text", F.lit("[.,;:!?]")).alias("n1"))
    total = F.col("n1") + F.col("n2")
    return m.select("doc_id", total.cast("long").alias("length"), F.round(total * F.log2(F.col("u2") + 6), 4).alias("volume"), F.round(F.lit(3.0) * F.col("n2") / F.greatest("u2", F.lit(1)), 4).alias("difficulty"))


@query("""WITH m AS (SELECT doc_id, len(string_split(text, chr(10))) AS loc, len(regexp_extract_all(text, '[.]')) AS sentences, len(string_split(text, ' ')) AS words FROM documents)
SELECT doc_id, round(greatest(0, (171 - 5.2 * ln(greatest(words, 1)) - 0.23 * sentences - 16.2 * ln(greatest(loc, 1))) * 100 / 171), 4) AS maintainability FROM m""")
def maintainability(spark: SparkSession, sf: str) -> DataFrame:
    """Maintainability index (F16)."""
    words, loc, sentences = F.size(F.split("text", " ")), F.size(F.split("text", "\n")), F.regexp_count("text", F.lit("[.]"))
    index = (171 - 5.2 * F.ln(F.greatest(words, F.lit(1))) - 0.23 * sentences - 16.2 * F.ln(F.greatest(loc, F.lit(1)))) * 100 / 171
    return v.table(spark, sf, "documents").select("doc_id", F.round(F.greatest(F.lit(0.0), index), 4).alias("maintainability"))


@query(f"WITH {v.LINES} SELECT doc_id, round(100.0 * count(*) FILTER (WHERE length(line) > 40) / count(*), 4) AS coverage FROM lines GROUP BY doc_id")
def doc_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of lines with more than forty characters."""
    return v.lines(spark, sf).groupBy("doc_id").agg(F.round(100.0 * F.count_if(F.length("line") > 40) / F.count(F.lit(1)), 4).alias("coverage"))


@query(f"WITH {HITS} SELECT doc_id, round(sum(CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.5 ELSE 0.25 END), 1) AS hours FROM hits GROUP BY doc_id")
def technical_debt(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of debt by severity of findings."""
    hours = F.expr("CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.5 ELSE 0.25 END").cast("double")
    return scan(v.lines(spark, sf)).groupBy("doc_id").agg(F.round(F.sum(hours), 1).alias("hours"))


@query("""SELECT doc_id, 'text' AS kind, 0.8::DOUBLE AS score FROM documents WHERE contains(lower(text), 'idiot') UNION ALL
SELECT doc_id, 'source', 1.0 FROM documents WHERE contains(lower(source), 'src1') ORDER BY score DESC, doc_id, kind LIMIT 200""")
def search_index(spark: SparkSession, sf: str) -> DataFrame:
    """Search over names and texts with scores (E14); the limit is the feature."""
    d = v.table(spark, sf, "documents")
    a = d.filter(F.lower("text").contains("idiot")).select("doc_id", F.lit("text").alias("kind"), F.lit(0.8).alias("score"))
    b = d.filter(F.lower("source").contains("src1")).select("doc_id", F.lit("source").alias("kind"), F.lit(1.0).alias("score"))
    return a.unionByName(b).orderBy(F.desc("score"), "doc_id", "kind").limit(200)


BLOCKS = f"""{v.LINES}, w AS (SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d || chr(10) || lead(line, 3) OVER d || chr(10) || lead(line, 4) OVER d AS block
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos))"""


@query(f"WITH {BLOCKS} SELECT md5(block) AS block, count(*) AS copies, count(DISTINCT doc_id) AS files, min(doc_id) AS first_file FROM w WHERE block IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of five lines that occur more than once."""
    d = Window.partitionBy("doc_id").orderBy("pos")
    block = F.concat(F.col("line"), *(x for k in range(1, 5) for x in (F.lit("\n"), F.lead("line", k).over(d))))
    w = v.lines(spark, sf).select("doc_id", F.md5(block).alias("block")).filter("block IS NOT NULL")
    return w.groupBy("block").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("doc_id").alias("files"), F.min("doc_id").alias("first_file")).filter("copies > 1")


@query("""WITH t AS (SELECT conv_id, CAST(floor(sum(length(text)) / 4) AS BIGINT) AS total, CAST(floor(sum(CASE WHEN turn = 0 THEN length(text) ELSE 0 END) / 4) AS BIGINT) AS target FROM conversations GROUP BY conv_id)
SELECT conv_id, total, target, CASE WHEN total <= 800 THEN 'whole' WHEN target <= 800 THEN 'target' ELSE 'cut' END AS fit FROM t""")
def token_budget_trim(spark: SparkSession, sf: str) -> DataFrame:
    """What of a conversation fits a token budget."""
    size = F.length("text")
    t = v.table(spark, sf, "conversations").groupBy("conv_id").agg(F.floor(F.sum(size) / 4).alias("total"), F.floor(F.sum(F.when(F.col("turn") == 0, size).otherwise(0)) / 4).alias("target"))
    return t.withColumn("fit", F.when(F.col("total") <= 800, "whole").when(F.col("target") <= 800, "target").otherwise("cut"))


LAYER = "CASE kind WHEN 'region' THEN 3 WHEN 'nation' THEN 2 WHEN 'customer' THEN 1 WHEN 'supplier' THEN 1 WHEN 'order' THEN 0 END"


@query(f"WITH {v.G_NODES}, l AS (SELECT type AS kind FROM g_nodes) SELECT kind, {LAYER} AS layer, count(*) AS n FROM l GROUP BY ALL")
def layer_classification(spark: SparkSession, sf: str) -> DataFrame:
    """Layer of each kind of node."""
    return v.g_nodes(spark, sf).groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("layer", F.expr(LAYER))


@query(f"""WITH {v.G_EDGES}, e AS (SELECT split_part(from_id, ':', 1) AS f, split_part(to_id, ':', 1) AS t FROM g_edges),
l AS (SELECT {LAYER.replace('kind', 'f')} AS a, {LAYER.replace('kind', 't')} AS b FROM e)
SELECT CASE WHEN a > b THEN 'upward_dependency' ELSE 'layer_skip' END AS violation, CASE WHEN a > b THEN 'MAJOR' ELSE 'MINOR' END AS severity, count(*) AS n FROM l WHERE a > b OR b - a > 1 GROUP BY ALL""")
def layer_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that point up or skip a layer; unlayered ends are exempt."""
    kind = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    layered = v.g_edges(spark, sf).select(kind("from_id").alias("f"), kind("to_id").alias("t")).select(F.expr(LAYER.replace("kind", "f")).alias("a"), F.expr(LAYER.replace("kind", "t")).alias("b"))
    up = F.col("a") > F.col("b")
    bad = layered.filter(up | (F.col("b") - F.col("a") > 1))
    return bad.groupBy(F.when(up, "upward_dependency").otherwise("layer_skip").alias("violation"), F.when(up, "MAJOR").otherwise("MINOR").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {v.U_EDGES}, t AS (SELECT min(src) AS id, 0 AS round FROM u_edges UNION SELECT u.src, t.round + 1 FROM t JOIN u_edges u ON u.dst = t.id WHERE t.round < 3)
SELECT id, min(round) AS round FROM t GROUP BY id""")
def taint_fixpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that return tainted values, found within three rounds."""
    from tessera.operators import graph as g

    e = v.u_edges(spark, sf)
    found = g.traverse(e.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id")), e.agg(F.min("src").alias("id")), 3, "in")
    return found.withColumnRenamed("depth", "round")
