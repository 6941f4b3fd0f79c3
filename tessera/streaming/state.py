"""Streaming operators with state of their own and sinks that may be written twice: re-analysis by content, streaks, the latest
events, and an audit log with retention (2.14).

State lives by event time: a key that has no rows for `ttl` is forgotten once the watermark says so, and counts as forgotten from
then on for rows that come before that. So a stream that is run again from its checkpoint, or from the start, finds the same,
and state stays as large as the keys of that time. Rows later than `late` are dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 24 * 3600


def _keyed(rows: DataFrame, key: str, late: str, ttl: int, schema: str, state_schema: str, step: Callable) -> DataFrame:
    """Apply step(key, frame by ts, state before or None) -> (rows, state after) to the rows of each key. The time of a key's last row
    is part of its state."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).sort_values([c for c in ("ts", "event_id", "digest") if c in names], ignore_index=True)
        last, *before = state.get if state.exists else (None,)
        gap = frame["ts"].diff().dt.total_seconds().fillna(0 if last is None else (frame["ts"][0] - pd.Timestamp(last)).total_seconds())
        held = tuple(before) if before else None
        for part, piece in frame.groupby((gap > ttl).cumsum()):  # each piece follows a gap in which the key was forgotten
            held = None if part > 0 else held
            out, held = step(keys[0], piece.reset_index(drop=True), held)
            yield out
        end = frame["ts"].iloc[-1].to_pydatetime() if last is None else max(frame["ts"].iloc[-1].to_pydatetime(), last)
        state.update((end, *held))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(end).timestamp() + ttl) * 1000, state.getCurrentWatermarkMs() + 1))

    names = rows.columns
    return rows.withWatermark("ts", late).groupBy(key).applyInPandasWithState(run, schema, f"last timestamp, {state_schema}", "append", GroupStateTimeout.EventTimeTimeout)


def reanalyse(files: DataFrame, ttl: int = 30 * DAY, late: str = "1 day") -> DataFrame:
    """path, ts, digest, reason (new or changed) of the versions of files (path, ts, text) that must be analysed again: those whose
    text differs from the version before (2.14s7). A path without a version for ttl seconds is new again. Null texts are empty, and
    rows with a null path or time are left out. Only digests are moved and kept."""

    def step(path: str, frame: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        old = held[0] if held else None
        before = frame["digest"].shift(fill_value="")
        if old is not None:
            before[0] = old
        fresh = frame[frame["digest"] != before]
        reason = ["new" if old is None and k == 0 else "changed" for k in fresh.index]
        return pd.DataFrame({"path": path, "ts": fresh["ts"], "digest": fresh["digest"], "reason": reason}), (frame["digest"].iloc[-1],)

    rows = files.filter("path IS NOT NULL AND ts IS NOT NULL").select("path", "ts", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return _keyed(rows, "path", late, ttl, "path string, ts timestamp, digest string, reason string", "digest string", step)


def failure_streaks(events: DataFrame, length: int = 3, ttl: int = 30 * DAY, late: str = "1 day") -> DataFrame:
    """user_id, ts, streak whenever a user has `length` errors in a row; a user's run is forgotten after ttl seconds without events."""

    def step(user: int, frame: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        failed = frame["event_type"] == "error"
        group = (~failed).cumsum()  # errors after the same success are one run, the first of which goes on from the state
        run = failed.groupby(group).cumsum() + (group == 0) * (held[0] if held else 0)
        found = frame[failed & (run == length)]
        return pd.DataFrame({"user_id": user, "ts": found["ts"], "streak": length}), (int(run.iloc[-1]) if failed.iloc[-1] else 0,)

    rows = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "event_type", "ts", "event_id")
    return _keyed(rows, "user_id", late, ttl, "user_id long, ts timestamp, streak int", "run int", step)


def latest_events(events: DataFrame, most: int = 100, ttl: int = 30 * DAY, late: str = "1 day") -> DataFrame:
    """event_type and event_ids, the `most` latest events of a type, newest first, whenever there are new ones (2.14s2)."""

    def step(kind: str, frame: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        seen = set(zip(*held, strict=True)) if held else set()
        new: set[tuple[datetime, int]] = set(zip(frame["ts"].dt.to_pydatetime(), frame["event_id"].tolist(), strict=True))
        latest = sorted(seen | new, reverse=True)[:most]
        times, ids = [t for t, _ in latest], [i for _, i in latest]
        return pd.DataFrame({"event_type": [kind], "event_ids": [ids]}), (times, ids)

    rows = events.filter("event_type IS NOT NULL AND ts IS NOT NULL").select("event_type", "ts", "event_id")
    return _keyed(rows, "event_type", late, ttl, "event_type string, event_ids array<long>", "times array<timestamp>, ids array<long>", step)


def append_audit(events: DataFrame, path: str, checkpoint: str, time: str = "ts", **trigger) -> StreamingQuery:
    """Start a query that appends events to a log in folders by day and batch (2.14s4, K4). A batch that is run again after a crash
    replaces its own folders and no others, so that the log neither lacks nor repeats an event."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"day": F.to_date(time), "batch": F.lit(number).cast("long")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return publish(events, write, checkpoint, **trigger)


def publish(events: DataFrame, *subscribers: Callable[[DataFrame, int], None] | str, **trigger) -> StreamingQuery:
    """Start a query that hands each batch and its number to all subscribers in turn; the last argument is the checkpoint folder
    (2.14s3). The batch is computed once. Subscribers may be called twice with one number, after a crash."""
    *called, checkpoint = subscribers

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for subscriber in called:
                subscriber(batch, number)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def forget_days(spark, path: str, first_day: str) -> list[str]:
    """Delete the days of a log before first_day (YYYY-MM-DD); the days that went (2.14s5, K4). Days are folders, so no file is
    rewritten."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = [f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith("day=")]
    old = sorted(p.getName() for p in days if p.getName()[4:] < first_day)  # the folder of null days sorts behind all dates
    for name in old:
        files.delete(hadoop.Path(root, name), True)
    return [name[4:] for name in old]
