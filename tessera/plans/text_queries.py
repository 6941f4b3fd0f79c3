"""Queries over the similarity of texts and over totals of telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import views as v

# fixed values: words that do not count
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "and", "or", "to", "of", "in", "for")


def word_set(text: Column) -> Column:
    """Distinct lower-case words of a text but for the stop words; null is empty."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_except(words, F.array(*(F.lit(w) for w in STOP_WORDS)))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if either is empty."""
    common, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / either).otherwise(F.lit(0.0))


@query(f"""WITH w AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')), lambda x: x NOT IN {STOP_WORDS}) AS s FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.s) > 0 AND len(b.s) > 0 THEN CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))) ELSE 0.0 END, 6) AS similarity
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of the word sets of each turn and the next one of its conversation (F5): one join by conversation and turn."""
    w = v.table(spark, sf, "conversations").select("conv_id", "turn", word_set(F.col("text")).alias("s"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("next"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(set_similarity(F.col("s"), F.col("next")), 6).alias("similarity"))


@query(f"""WITH {v.CALLS} SELECT tool, count(*) AS total, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures,
  round(CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*), 6) AS success_rate, round(coalesce(avg(duration) FILTER (WHERE duration > 0), 0.0), 4) AS mean_positive_duration FROM calls GROUP BY ROLLUP (tool)""")
def telemetry_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, successes, failures and their rate by tool and over all (null), with the mean of durations above 0 (A2)."""
    ok = F.count_if("ok")
    return v.calls(spark, sf).rollup("tool").agg(
        F.count(F.lit(1)).alias("total"), ok.alias("successes"), F.count_if(~F.col("ok")).alias("failures"),
        F.round(ok / F.count(F.lit(1)), 6).alias("success_rate"), F.round(F.coalesce(F.avg(F.when(F.col("duration") > 0, F.col("duration"))), F.lit(0.0)), 4).alias("mean_positive_duration"),
    )
