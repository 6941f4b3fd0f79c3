"""Streaming forms of the event operators: windowed counts, sessions, dedup and custom per-key state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and totals by window and type; windows close once the watermark has passed them."""
    w = F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("started"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, which end after a gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("started"), "n")


def first_of_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of their id within the watermark; the state is bounded by it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def failure_streaks(events: DataFrame, length: int = 3) -> DataFrame:
    """user_id and streak whenever a user has `length` errors in a row: one integer of state for each user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        found = []
        for frame in frames:
            for kind in frame.sort_values(["ts", "event_id"])["event_type"]:
                run = run + 1 if kind == "error" else 0
                if run == length:
                    found.append(run)
        state.update((run,))
        yield pd.DataFrame({"user_id": [key[0]] * len(found), "streak": found})

    keyed = events.select("user_id", "event_type", "ts", "event_id").groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id long, streak int", "run int", "append", "NoTimeout")
