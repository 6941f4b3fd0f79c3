"""Aggregates, windows and governance queries of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.registry import query
from tessera.sources import views as v


def _band(column: str, bands: tuple[tuple[int, str], ...], least: str) -> str:
    """CASE over falling thresholds."""
    return "CASE " + " ".join(f"WHEN {column} >= {n} THEN '{name}'" for n, name in bands) + f" ELSE '{least}' END"


@query(f"""WITH {v.CALLS} SELECT tool, count(*) AS calls, count(*) FILTER (WHERE ok) AS successes, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 4) AS success_rate,
  round(avg(duration), 4) AS mean_duration, round(max(duration), 4) AS max_duration, count(DISTINCT request_id) AS requests FROM calls GROUP BY tool""")
def tool_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, successes and durations of each tool (A1)."""
    return v.calls(spark, sf).groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("ok").alias("successes"), F.round(F.avg(F.col("ok").cast("double")), 4).alias("success_rate"),
        F.round(F.avg("duration"), 4).alias("mean_duration"), F.round(F.max("duration"), 4).alias("max_duration"), F.countDistinct("request_id").alias("requests"),
    )


@query(f"""WITH {v.CALLS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failures, count(DISTINCT tool) AS tools,
  round(quantile_cont(duration, 0.5), 4) AS median_duration, round(quantile_cont(duration, 0.95), 4) AS p95_duration FROM calls GROUP BY ALL""")
def telemetry_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Daily calls, failures and duration percentiles (A2)."""
    return v.calls(spark, sf).groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.countDistinct("tool").alias("tools"),
        F.round(F.percentile("duration", 0.5), 4).alias("median_duration"), F.round(F.percentile("duration", 0.95), 4).alias("p95_duration"),
    )


@query(f"""WITH {v.CALLS} SELECT request_id, count(*) FILTER (WHERE tool = 'purchase') AS accepted, count(*) FILTER (WHERE tool = 'view') AS shown,
  round(count(*) FILTER (WHERE tool = 'purchase') / greatest(count(*) FILTER (WHERE tool = 'view'), 1), 4) AS acceptance FROM calls GROUP BY request_id""")
def suggestion_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions shown and accepted (A3)."""
    accepted, shown = F.count_if(F.col("tool") == "purchase"), F.count_if(F.col("tool") == "view")
    return v.calls(spark, sf).groupBy("request_id").agg(accepted.alias("accepted"), shown.alias("shown"), F.round(accepted / F.greatest(shown, F.lit(1)), 4).alias("acceptance"))


@query(f"WITH {v.CALLS} SELECT event_id, tool, ts FROM calls WHERE ok ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def event_page(spark: SparkSession, sf: str) -> DataFrame:
    """Third page of the newest successful calls."""
    return v.calls(spark, sf).filter("ok").orderBy(F.desc("ts"), F.desc("event_id")).offset(50).limit(25).select("event_id", "tool", "ts")


@query(f"WITH {v.CALLS} SELECT request_id, CAST(count(*) AS INTEGER) AS length, string_agg(tool, '>' ORDER BY ts, event_id) AS chain FROM calls GROUP BY request_id")
def call_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered calls of each request."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "tool")))
    return v.calls(spark, sf).groupBy("request_id").agg(F.count(F.lit(1)).cast("int").alias("length"), F.array_join(F.transform(steps, lambda s: s["tool"]), ">").alias("chain"))


@query("""SELECT metric, count(*) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most, round(stddev_samp(value), 4) AS deviation FROM (
  SELECT 'quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY metric""")
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics in long form and their summaries: one unpivot and one aggregate (A4)."""
    line = v.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = line.unpivot([], ["quantity", "discount", "tax"], "metric", "value")
    stats = (("mean", F.avg), ("least", F.min), ("most", F.max), ("deviation", F.stddev_samp))
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), *(F.round(f("value"), 4).alias(n) for n, f in stats))


GRADE = _band("score", ((90, "A"), (80, "B"), (70, "C"), (60, "D")), "F")
RISK = _band("score", ((80, "LOW"), (60, "MEDIUM"), (40, "HIGH")), "CRITICAL")
TOTALS = """t AS (SELECT count(*) FILTER (WHERE event_type LIKE 'OPERATION_%') AS total, count(*) FILTER (WHERE event_type = 'POLICY_VIOLATION') AS blocked,
  count(*) FILTER (WHERE event_type = 'OVERRIDE_REQUESTED') AS requested, count(*) FILTER (WHERE event_type = 'OVERRIDE_APPROVED') AS approved FROM gov)"""


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    is_ = lambda k: F.count_if(F.col("event_type") == k)
    return v.gov(spark, sf).agg(
        F.count_if(F.col("event_type").startswith("OPERATION_")).alias("total"), is_("POLICY_VIOLATION").alias("blocked"),
        is_("OVERRIDE_REQUESTED").alias("requested"), is_("OVERRIDE_APPROVED").alias("approved"),
    )


@query(f"WITH {v.GOV}, {TOTALS} SELECT total, blocked, requested, approved, round(approved / greatest(requested, 1), 4) AS approval_rate FROM t")
def governance_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Operations, violations and overrides."""
    return _totals(spark, sf).withColumn("approval_rate", F.round(F.col("approved") / F.greatest("requested", F.lit(1)), 4))


@query(f"""WITH {v.GOV} SELECT policy, count(*) AS violations, count(DISTINCT user_id) AS users, CAST(rank() OVER (ORDER BY count(*) DESC, policy) AS INTEGER) AS place
FROM gov WHERE event_type = 'POLICY_VIOLATION' GROUP BY policy""")
def violated_policy_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Policies by violations."""
    g = v.gov(spark, sf).filter("event_type = 'POLICY_VIOLATION'").groupBy("policy").agg(F.count(F.lit(1)).alias("violations"), F.countDistinct("user_id").alias("users"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("violations"), "policy")))


@query(f"WITH {v.GOV} SELECT policy, severity, count(*) AS n FROM gov WHERE event_type = 'POLICY_VIOLATION' GROUP BY GROUPING SETS ((policy), (severity), (policy, severity), ())")
def violations_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Violations by policy, by severity, by both and in all."""
    return v.gov(spark, sf).filter("event_type = 'POLICY_VIOLATION'").cube("policy", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {v.GOV} SELECT user_id, count(*) FILTER (WHERE event_type = 'OVERRIDE_REQUESTED') AS requested, count(*) FILTER (WHERE event_type = 'OVERRIDE_APPROVED') AS approved
FROM gov GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'OVERRIDE_REQUESTED') > 0""")
def override_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Overrides by user."""
    is_ = lambda k: F.count_if(F.col("event_type") == k)
    return v.gov(spark, sf).groupBy("user_id").agg(is_("OVERRIDE_REQUESTED").alias("requested"), is_("OVERRIDE_APPROVED").alias("approved")).filter("requested > 0")


SCORE = "CASE WHEN total = 0 THEN 100 ELSE CAST(trunc(least(blocked * 1.0 / total, 1) * 50 + (1 - least(approved * 1.0 / greatest(blocked, 1), 1)) * 50) AS INTEGER) END"


@query(f"WITH {v.GOV}, {TOTALS}, s AS (SELECT {SCORE} AS score FROM t) SELECT score, {GRADE} AS grade, {RISK} AS risk FROM s")
def security_posture(spark: SparkSession, sf: str) -> DataFrame:
    """Posture score, grade and risk."""
    share = F.least(F.col("blocked") / F.col("total"), F.lit(1)) * 50 + (1 - F.least(F.col("approved") / F.greatest("blocked", F.lit(1)), F.lit(1))) * 50
    score = F.when(F.col("total") == 0, 100).otherwise(F.floor(share).cast("int"))
    return _totals(spark, sf).select(score.alias("score")).select("score", F.expr(GRADE).alias("grade"), F.expr(RISK).alias("risk"))


ADVICE = "CASE WHEN violations >= 0.2 * total THEN 'review policy' WHEN critical > 0 THEN 'fix critical' ELSE 'keep' END"


@query(f"""WITH {v.GOV}, p AS (SELECT policy, count(*) AS total, count(*) FILTER (WHERE event_type = 'POLICY_VIOLATION') AS violations,
  count(*) FILTER (WHERE event_type = 'POLICY_VIOLATION' AND severity = 'CRITICAL') AS critical FROM gov GROUP BY policy) SELECT policy, {ADVICE} AS advice FROM p""")
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Advice for each policy."""
    bad = F.col("event_type") == "POLICY_VIOLATION"
    p = v.gov(spark, sf).groupBy("policy").agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("violations"), F.count_if(bad & (F.col("severity") == "CRITICAL")).alias("critical"))
    return p.select("policy", F.expr(ADVICE).alias("advice"))


@query("""WITH o AS (SELECT c_nationkey AS nation, l_suppkey AS owner, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY n DESC, owner) AS place, sum(n) OVER (PARTITION BY nation) AS total FROM o)
SELECT nation, owner, n, round(n / total, 6) AS share, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def ownership_share(spark: SparkSession, sf: str) -> DataFrame:
    """The five owners of the largest share in each nation."""
    t = lambda n: v.table(spark, sf, n)
    o = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.groupBy(F.col("c_nationkey").alias("nation"), F.col("l_suppkey").alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    nation = Window.partitionBy("nation")
    o = o.withColumns({"place": F.row_number().over(nation.orderBy(F.desc("n"), "owner")), "total": F.sum("n").over(nation)}).filter("place <= 5")
    return o.select("nation", "owner", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "place")


@query("""WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS change, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS weekly FROM d""")
def activity_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts, changes and moving means."""
    d = v.table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy("day")
    return d.select("event_type", "day", "n", (F.col("n") - F.lag("n").over(w)).alias("change"), F.round(F.avg("n").over(w.rowsBetween(-6, 0)), 4).alias("weekly"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, round(max(value) FILTER (WHERE k = 1) - max_by(value, k), 6) AS trend, count(*) AS samples FROM r WHERE k <= 50 GROUP BY user_id""")
def complexity_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Last minus first of the last fifty samples."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    r = v.table(spark, sf, "events").withColumn("k", F.row_number().over(w)).filter("k <= 50")
    return r.groupBy("user_id").agg(F.round(F.min_by("value", "k") - F.max_by("value", "k"), 6).alias("trend"), F.count(F.lit(1)).alias("samples"))


POINTS = "CASE WHEN refs >= 100 THEN 25 WHEN refs >= 50 THEN 20 WHEN refs >= 20 THEN 10 ELSE 0 END + CASE WHEN files >= 20 THEN 25 WHEN files >= 10 THEN 15 WHEN files >= 5 THEN 8 ELSE 0 END + CASE WHEN test_ratio < 0.1 THEN 20 WHEN test_ratio < 0.3 THEN 10 ELSE 0 END"


@query(f"""WITH p AS (SELECT l_partkey AS symbol, count(*) AS refs, count(DISTINCT l_orderkey) AS files, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS test_ratio FROM lineitem GROUP BY l_partkey),
s AS (SELECT *, {POINTS} AS points FROM p) SELECT symbol, refs, files, points, CASE WHEN points >= 60 THEN 'high' WHEN points >= 30 THEN 'medium' ELSE 'low' END AS risk FROM s""")
def symbol_reference_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk by references, files and test share."""
    ratio = F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6)
    p = v.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("symbol")).agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("l_orderkey").alias("files"), ratio.alias("test_ratio"))
    p = p.withColumn("points", F.expr(POINTS))
    return p.select("symbol", "refs", "files", "points", F.expr(_band("points", ((60, "high"), (30, "medium")), "low")).alias("risk"))


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 49),
o AS (SELECT a AS nation, count(*) AS ce FROM e WHERE a <> b GROUP BY a), i AS (SELECT b AS nation, count(*) AS ca FROM e WHERE a <> b GROUP BY b)
SELECT n_nationkey AS nation, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0.0 ELSE round(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)), 3) END AS instability
FROM nation LEFT JOIN o ON o.nation = n_nationkey LEFT JOIN i ON i.nation = n_nationkey""")
def coupling_instability(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours and instability of each nation by lines of quantity 49 on, as its SQL has it; all: coupling_instability_all."""
    return _coupling(spark, sf, v.table(spark, sf, "lineitem").filter("l_quantity >= 49"))


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
o AS (SELECT a AS nation, count(*) AS ce FROM e WHERE a <> b GROUP BY a), i AS (SELECT b AS nation, count(*) AS ca FROM e WHERE a <> b GROUP BY b)
SELECT n_nationkey AS nation, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0.0 ELSE round(coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)), 3) END AS instability
FROM nation LEFT JOIN o ON o.nation = n_nationkey LEFT JOIN i ON i.nation = n_nationkey""")
def coupling_instability_all(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct neighbours in and out and the instability of each nation."""
    return _coupling(spark, sf, v.table(spark, sf, "lineitem"))


def _coupling(spark: SparkSession, sf: str, line: DataFrame) -> DataFrame:
    t = lambda n: v.table(spark, sf, n)
    e = line.select("l_suppkey", "l_orderkey").distinct().join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = e.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).distinct().filter("a <> b")
    ends = e.select(F.col("a").alias("nation"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("b").alias("nation"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    ends = ends.unionByName(t("nation").select(F.col("n_nationkey").alias("nation"), F.lit(0).alias("o"), F.lit(0).alias("i")))
    d = ends.groupBy("nation").agg(F.sum("i").alias("ca"), F.sum("o").alias("ce"))
    total = F.col("ca") + F.col("ce")
    return d.withColumn("instability", F.when(total == 0, 0.0).otherwise(F.round(F.col("ce") / total, 3)))


CHURN = "CASE WHEN churn > 20 THEN 'high' WHEN churn > 10 THEN 'medium' ELSE 'low' END"


@query(f"WITH c AS (SELECT o_custkey AS id, count(*) + count(DISTINCT o_orderstatus) AS churn FROM orders GROUP BY o_custkey) SELECT id, churn, {CHURN} AS band FROM c")
def churn_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Churn bands."""
    c = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.count(F.lit(1)) + F.countDistinct("o_orderstatus")).alias("churn"))
    return c.withColumn("band", F.expr(CHURN))


@query("SELECT l_suppkey AS id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS defects FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') * 3 > count(*)")
def bug_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with more than a third of their lines returned (A10)."""
    s = v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("defects"))
    return s.filter("defects * 3 > n")


SUPPLY = ("CASE WHEN critical > 0 THEN 90 WHEN high > 5 THEN 60 WHEN high > 2 THEN 50 WHEN high > 0 THEN 30 ELSE 10 END", "CASE WHEN depth > 20 THEN 70 ELSE 30 END")


@query(f"""WITH s AS (SELECT l_suppkey AS id, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity = 50) AS critical, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity >= 45) AS high, count(DISTINCT l_partkey) AS depth FROM lineitem GROUP BY l_suppkey),
r AS (SELECT id, round(0.35 * ({SUPPLY[0]}) + 0.25 * 25 + 0.15 * 20 + 0.15 * 40 + 0.10 * ({SUPPLY[1]}), 2) AS overall FROM s)
SELECT id, overall, {_band('overall', ((70, 'CRITICAL'), (50, 'HIGH'), (30, 'MEDIUM')), 'LOW')} AS level FROM r""")
def supply_chain_score(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted supply-chain score."""
    returned = F.col("l_returnflag") == "R"
    s = v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.count_if(returned & (F.col("l_quantity") == 50)).alias("critical"), F.count_if(returned & (F.col("l_quantity") >= 45)).alias("high"), F.countDistinct("l_partkey").alias("depth"))
    overall = F.round(0.35 * F.expr(SUPPLY[0]) + F.lit(0.25 * 25 + 0.15 * 20 + 0.15 * 40) + 0.10 * F.expr(SUPPLY[1]), 2)
    return s.select("id", overall.alias("overall")).withColumn("level", F.expr(_band("overall", ((70, "CRITICAL"), (50, "HIGH"), (30, "MEDIUM")), "LOW")))


@query("SELECT source, lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY source, lang")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Files and sizes by source and language."""
    return v.table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("SELECT lang, count(*) AS files, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY lang")
def language_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Files by language."""
    return v.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with a gap of six hours: the batch twin of the streaming operator."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.lag("ts").over(w).isNull() | (F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS")), 1).otherwise(0)
    s = v.table(spark, sf, "events").withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n")).drop("session")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly windows by type: the batch twin of the streaming operator."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return v.table(spark, sf, "events").groupBy(hour.alias("started"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, event_type, min(ts) AS ts, count(*) AS n FROM events GROUP BY user_id, event_type")
def watermark_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """First event of each user and type: the batch twin of streaming dedup."""
    return v.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
SELECT event_type, count(*) FILTER (WHERE k = 1) AS firsts, count(*) FILTER (WHERE k > 1) AS reassigned FROM r GROUP BY event_type""")
def first_vs_reassign(spark: SparkSession, sf: str) -> DataFrame:
    """First assignments and later ones."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    r = v.table(spark, sf, "events").withColumn("k", F.row_number().over(w))
    return r.groupBy("event_type").agg(F.count_if(F.col("k") == 1).alias("firsts"), F.count_if(F.col("k") > 1).alias("reassigned"))


@query("""SELECT o_orderkey AS id, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total, count(*) > 6 AS too_many, max(l_quantity) > 49 AS too_large, bool_or(p_type LIKE '%COPPER%') AS forbidden
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey HAVING count(*) > 6 OR max(l_quantity) > 49 OR bool_or(p_type LIKE '%COPPER%')""")
def budget_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that break a change budget."""
    t = lambda n: v.table(spark, sf, n)
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy(F.col("o_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"), (F.count(F.lit(1)) > 6).alias("too_many"),
        (F.max("l_quantity") > 49).alias("too_large"), F.bool_or(F.col("p_type").contains("COPPER")).alias("forbidden"))
    return g.filter("too_many OR too_large OR forbidden")
