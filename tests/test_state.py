"""Streams with their own state, and the audit log, over restarts from a checkpoint."""

from __future__ import annotations

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessera.streaming import state

DAY = dt.datetime(2024, 1, 1)


def feed(spark, folder, rows, schema):
    """One more file of input."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, schema, op, out, checkpoint):
    stream = op(spark.readStream.schema(schema).parquet(folder))
    collected = []
    q = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: collected.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(180)
    out.extend(collected)


def test_reanalysis_over_a_restart(spark, tmp_path):
    schema, folder, checkpoint, out = "path string, ts timestamp, text string", f"file://{tmp_path}/in", f"file://{tmp_path}/cp", []
    hour = lambda h: DAY + dt.timedelta(hours=h)
    feed(spark, folder, [("a", hour(0), "1"), ("b", hour(0), "1"), ("a", hour(1), "1"), ("a", hour(2), "2"), (None, hour(0), "x"), ("n", hour(0), None)], schema)
    run(spark, folder, schema, state.reanalyse, out, checkpoint)
    assert sorted((r.path, r.ts, r.reason) for r in out) == [("a", hour(0), "new"), ("a", hour(2), "changed"), ("b", hour(0), "new"), ("n", hour(0), "new")]
    assert {r.digest for r in out if r.path == "n"} == {hashlib.sha256(b"").hexdigest()}
    out.clear()
    feed(spark, folder, [("a", hour(3), "2"), ("b", hour(3), "9"), ("c", hour(3), "1")], schema)
    run(spark, folder, schema, state.reanalyse, out, checkpoint)
    assert sorted((r.path, r.reason) for r in out) == [("b", "changed"), ("c", "new")]
    out.clear()
    run(spark, folder, schema, state.reanalyse, out, checkpoint)
    assert out == []


def test_state_expires(spark, tmp_path):
    schema, folder, checkpoint, out = "path string, ts timestamp, text string", f"file://{tmp_path}/in", f"file://{tmp_path}/cp", []
    op = lambda s: state.reanalyse(s, ttl=3600)
    at = lambda m: DAY + dt.timedelta(minutes=m)
    for rows in ([("a", at(0), "1"), ("a", at(50), "1"), ("a", at(200), "1")], [("a", at(250), "1"), ("b", at(400), "1")], [("a", at(420), "1")]):
        feed(spark, folder, rows, schema)
        run(spark, folder, schema, op, out, checkpoint)
    assert [(r.path, r.ts, r.reason) for r in out] == [("a", at(0), "new"), ("a", at(200), "new"), ("b", at(400), "new"), ("a", at(420), "new")]


def test_streaks_and_latest(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    rows = [(k, DAY + dt.timedelta(minutes=k), k % 3, "error" if (k * 7919) % 5 < 3 else "view") for k in range(120)]
    folder, out, latest = f"file://{tmp_path}/in", [], []
    want, runs = [], {}
    for _, ts, user, kind in rows:
        runs[user] = runs.get(user, 0) + 1 if kind == "error" else 0
        want += [(user, ts, 2)] if runs[user] == 2 else []
    for part in (rows[:50], rows[50:53], rows[53:]):
        feed(spark, folder, part, schema)
        run(spark, folder, schema, lambda s: state.failure_streaks(s, 2), out, f"file://{tmp_path}/cp1")
        run(spark, folder, schema, lambda s: state.latest_events(s, 4), latest, f"file://{tmp_path}/cp2")
    assert want and sorted((r.user_id, r.ts, r.streak) for r in out) == sorted(want)
    last = {r.event_type: r.event_ids for r in latest}
    assert last == {k: [r[0] for r in reversed(rows) if r[3] == k][:4] for k in ("error", "view")}


def test_audit_log_survives_a_crash(spark, tmp_path):
    schema, folder, log, checkpoint = "event_id long, ts timestamp", f"file://{tmp_path}/in", f"file://{tmp_path}/log", f"file://{tmp_path}/cp"
    rows = [(k, DAY + dt.timedelta(hours=7 * k)) for k in range(30)]
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    told = []

    def crash(batch, number):
        told.append((number, batch.count()))
        batch.withColumns({"day": F.to_date("ts"), "batch": F.lit(number).cast("long")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(log)
        if number == 1:
            raise RuntimeError("lost after the write")

    feed(spark, folder, rows[:10], schema)
    feed(spark, folder, rows[10:20], schema)
    with pytest.raises(Exception, match="lost after the write"):
        state.publish(stream(), crash, checkpoint).awaitTermination(180)
    state.append_audit(stream(), log, checkpoint).awaitTermination(180)  # batch 1 again
    feed(spark, folder, rows[20:], schema)
    state.append_audit(stream(), log, checkpoint).awaitTermination(180)
    assert told == [(0, 10), (1, 10)] and sorted(r.event_id for r in spark.read.parquet(log).collect()) == list(range(30))
    gone = state.forget_days(spark, log, "2024-01-04")
    assert gone == ["2024-01-01", "2024-01-02", "2024-01-03"] and not os.path.exists(f"{tmp_path}/log/day=2024-01-03")
    assert sorted(r.event_id for r in spark.read.parquet(log).collect()) == [k for k, ts in rows if ts >= dt.datetime(2024, 1, 4)]
