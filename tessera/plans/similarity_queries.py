"""Queries over alike names and functions. Matching blocks are beyond SQL: tests/test_similarity.py compares with the standard library
over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import parsing
from tessera.operators import similarity as s
from tessera.operators.lineage import cut
from tessera.plans.registry import query
from tessera.sources import views as v


@query()
def semantic_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten functions most like each function of a file whose number divides by 20."""
    files = v.src(spark, sf)
    functions = cut(parsing.signatures(files.select("path", F.col("code").alias("text"))))
    asked = functions.join(files.filter("file_id % 20 = 0").select("path"), "path", "left_semi")
    return s.neighbours(asked, functions)


@query()
def typosquat_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the documents that are spelt almost like one of the hundred most frequent longer ones."""
    text = v.table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("name"))
    count = cut(text.filter(F.length("name") > 4).groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    return s.typosquats(count, count.orderBy(F.desc("n"), "name").limit(100))
