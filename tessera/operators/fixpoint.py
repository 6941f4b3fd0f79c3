"""Two drivers for iterative operators: relations that grow, and values by key that settle.

Both run a few steps as one job, write what comes out to the shared folder and read it back, so that a lost executor costs one
job's work at most, and delete the tables that are no longer read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut, discard, together

Step = Callable[[DataFrame], DataFrame]


def spread(seeds: DataFrame, step: Step, hops: int = 3, pairs: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """seeds and all rows that step makes of them, of what it makes of them, and so on (semi-naive: only new rows make more). Where
    two rows make one, pairs(new, all) has what a new row makes with any."""
    columns = seeds.columns
    parts = [cut(seeds.distinct())]
    fresh = parts[0]
    while True:
        met = cut(pairs(fresh, together(parts)).select(*columns).distinct()) if pairs else None
        found = [fresh.unionByName(met) if pairs else fresh]
        for _ in range(hops):
            found.append(step(found[-1]).select(*columns).distinct())
        known = together(parts).select(*(F.col(c).alias(f"known_{c}") for c in columns))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in columns))
        fresh = cut(reduce(DataFrame.unionByName, [*([met] if pairs else []), *found[1:]]).distinct().join(known, same, "left_anti"))
        if pairs:
            discard(met)
        if fresh.isEmpty():
            discard(fresh)
            return together(parts)
        parts.append(fresh)


def settle(state: DataFrame, messages: Step, merge: Callable[[str], Column] = F.min, hops: int = 3) -> DataFrame:
    """state (keys and `value`) after its messages, which have the same columns, have been merged into it until none changes a
    value. merge must not mind repeats, order or nulls, as is true of F.min and F.max."""
    keys = [c for c in state.columns if c != "value"]
    kind = state.schema["value"].dataType
    null = F.lit(None).cast(kind)
    now = cut(state.groupBy(*keys).agg(merge("value").alias("value")))
    while True:
        grown = now
        for _ in range(hops - 1):
            grown = grown.unionByName(messages(grown)).groupBy(*keys).agg(merge("value").alias("value"))
        parts = grown.unionByName(messages(grown)).withColumn("was", null).unionByName(now.select(*keys, null.alias("value"), F.col("value").alias("was")))
        new = cut(parts.groupBy(*keys).agg(merge("value").alias("value"), F.max("was").alias("was")))
        done = new.filter(~F.col("value").eqNullSafe(F.col("was"))).isEmpty()
        discard(now)
        if done:
            return new.drop("was")
        now = cut_columns(new, state.columns)


def cut_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Some columns of a table that cut() has written, which discard() still finds."""
    from tessera.operators import lineage

    out = df.select(*columns)
    lineage._WRITTEN[out] = lineage._WRITTEN.pop(df)
    return out
