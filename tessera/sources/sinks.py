"""Results as files and texts: graphs, diagrams, metrics, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines in two folders (K1)."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """One line of a Mermaid flow chart for each edge, the head line first (K2). The caller bounds the edges it draws."""
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    line = F.concat(F.lit("  "), safe("from_id"), F.lit('["'), F.col("from_id"), F.lit('"] --> '), safe("to_id"), F.lit('["'), F.col("to_id"), F.lit('"]'))
    head = edges.sparkSession.createDataFrame([(0, "graph TD")], "place int, line string")
    return head.unionByName(edges.select(F.lit(1).alias("place"), line.alias("line")).distinct()).orderBy("place", "line").select("line")


def metrics(df: DataFrame, path: str, form: str = "json") -> None:
    """Metrics as JSON or CSV (K3)."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if form == "csv" else writer.json(path)


def append_audit(events: DataFrame, path: str, time: str = "ts") -> None:
    """Events appended to a log that is partitioned by day, so that old days can be dropped (K4)."""
    events.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def keep_days(spark, path: str, first_day: str) -> DataFrame:
    """The days of a log from first_day on: partitions before it are not read (K4)."""
    return spark.read.parquet(path).filter(F.col("day") >= F.lit(first_day).cast("date"))


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields of a response profile that exist (K7)."""
    return df.select(*(f for f in fields if f in df.columns))
