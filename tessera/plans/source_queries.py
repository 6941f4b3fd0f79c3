"""Queries that parse the source files of all parts, and signatures over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import parsing, signing
from tessera.plans.code_queries import CALLS
from tessera.plans.registry import query
from tessera.sources import views as v

KEY = b"audit"


def _hmac_sql(payload: str) -> str:
    """SQL for the HMAC-SHA256 of a text under KEY, which is shorter than a block."""
    inner, outer = (bytes(b ^ mask for b in KEY.ljust(signing.BLOCK, b"\0")).hex() for mask in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({payload}))))"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return v.src(spark, sf).select("path", F.col("code").alias("text"))


@query(f"WITH {CALLS} SELECT s.path, s.name AS caller, c.callee, c.pos AS line FROM called c JOIN symbols s ON s.file_id = c.file_id AND pos BETWEEN start AND stop")
def python_ast_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by scope, from the syntax trees of all source files."""
    return parsing.python_calls(_files(spark, sf))


@query(f"""WITH {v.SRC_LINES}, stored AS (SELECT path, pos, regexp_extract(line, '^ *(?:for )?([a-z_]+) (?:=|in) ', 1) AS name FROM src_lines WHERE regexp_matches(line, '^ *(?:[a-z_]+ =|for [a-z_]+ in) ')),
read AS (SELECT DISTINCT path, pos, unnest(regexp_extract_all(regexp_replace(line, '^ *(?:[a-z_]+ =|for [a-z_]+ in) |#.*|"[^"]+"', ''), '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM src_lines)
SELECT r.path, r.name, max(s.pos) AS def_line, r.pos AS use_line FROM read r JOIN stored s ON s.path = r.path AND s.name = r.name AND s.pos < r.pos GROUP BY r.path, r.name, r.pos""")
def pdg_edges_udtf(spark: SparkSession, sf: str) -> DataFrame:
    """Data-dependency edges, from the syntax trees of all source files."""
    return parsing.def_use_edges(_files(spark, sf))


@query(f"""WITH RECURSIVE {v.M_EDGES}, walk(id, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 11 = 0 UNION
  SELECT e.from_id, w.depth + 1 FROM walk w JOIN m_edges e ON e.to_id = w.id WHERE w.depth < 3)
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY id""")
def cross_file_taint(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that reach one with a query through up to three calls, with their distance."""
    from tessera.operators import graph as g

    sinks = v.table(spark, sf, "part").filter("p_partkey % 11 = 0").select(F.col("p_partkey").alias("id"))
    return g.traverse(v.m_edges(spark, sf), sinks, 3, "in")


@query(f"""WITH e AS (SELECT event_id, concat_ws('|', event_type, CAST(user_id AS VARCHAR)) AS payload FROM events)
SELECT {_hmac_sql("CASE WHEN event_id % 7 = 0 THEN payload || 'x' ELSE payload END")} = {_hmac_sql("payload")} AS valid, count(*) AS n FROM e GROUP BY 1""")
def hmac_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Audit entries and whether their signatures hold; every seventh was changed after signing."""
    e = v.table(spark, sf, "events").select("event_id", F.concat_ws("|", F.col("event_type"), F.col("user_id").cast("string")).alias("payload"))
    signed = e.withColumn("signature", signing.hmac_sha256(F.col("payload"), KEY)).withColumn("payload", F.when(F.col("event_id") % 7 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    return signing.verified(signed, KEY).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))
