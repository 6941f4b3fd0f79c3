"""Streaming operators against their batch results on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming import windows

SF = "/root/testdata/sf0.001"


def events(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    raw = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(SF).withColumn("ts", F.col("ts").cast("timestamp"))
    return batch, stream


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_tumbling_and_sessions(spark):
    batch, stream = events(spark)
    for name, op in (("tumbling", windows.tumbling), ("sessions", windows.sessions)):
        drain(op(stream), name, "append" if name == "sessions" else "complete")
        got = {tuple(r)[:3] for r in spark.sql(f"SELECT * FROM {name}").collect()}
        want = {tuple(r)[:3] for r in op(batch).collect()}
        assert got and (got == want if name == "tumbling" else got <= want)


def test_dedup_and_streaks(spark):
    batch, stream = events(spark)
    drain(windows.first_of_each(stream.unionByName(stream)), "firsts", "append")
    assert spark.table("firsts").count() == batch.count()
    drain(windows.failure_streaks(stream, 2), "streaks", "append")
    want = 0
    for user in batch.select("user_id").distinct().collect():
        run = 0
        for r in batch.filter(F.col("user_id") == user.user_id).orderBy("ts", "event_id").collect() if user.user_id < 20 else []:
            run = run + 1 if r.event_type == "error" else 0
            want += run == 2
    assert spark.sql("SELECT * FROM streaks WHERE user_id < 20").count() == want
