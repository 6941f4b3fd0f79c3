"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has `points` virtual nodes on the ring of 64-bit hashes. A row's place on the ring is the hash of its text, so
that equal texts lie together; it belongs to the first virtual node at or after its place. Each shard takes a share of the
rows that differs from the others' by one at most. Rows that their node's shard has no room for continue clockwise to the
next node, until a shard takes them: in round t each virtual node offers what is left of it to the t-th node after it, and
a shard with too little room takes the offers in the order of the ring, the last one in part. So a group of equal texts is
parted only where a shard becomes full, which happens once a shard, and another shard or other rows move few rows.

Rows get their order along the ring by a range sort of (place, id, salt), where the salt parts a hot text or id among tasks;
their number within the partition is kept. Which shard takes which rows of a virtual node is worked out from the counts of
rows by partition and node, which are at most as many as partitions and nodes together, since both follow the ring; the same
bound, and one more for each shard, holds for the table of runs that is broadcast. A row finds its run by partition and node
and gets shard and slot by arithmetic. Texts are read once and do not move, unless `keep` asks for them.

Defined cases: a null text lies with the empty one and has size 1, and crc32 0; null ids are rows like others; repeated rows
each get a slot of their own; without rows the result is empty; fewer rows than shards leave the last shards empty; columns
of docs that are not kept are ignored, and kept ones with the names of the result's own give way.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import released, stored

CELL_BITS = 16  # the ring in equal cells, by which places find their virtual nodes
LEAST, MOST = -(1 << 63), (1 << 63) - 1
PART_BITS = 33  # monotonically_increasing_id has the partition above them and the row's number below
RESULT = ("size", "text_crc32", "shard", "slot")


def ring(spark: SparkSession, shards: int, points: int) -> DataFrame:
    """node (in ring order), shard and the places (low, high] of each virtual node. The rows beyond the last one belong to the
    first; they are one more node, so that nodes follow the order of places."""
    shard, point = (F.col("id") / points).cast("int"), F.col("id") % points  # a shard's nodes do not depend on how many shards there are
    spots = spark.range(shards * points).select(shard.alias("shard"), F.xxhash64(F.lit("node"), shard, point).alias("high"))
    order = Window.orderBy("high", "shard")  # of shards * points rows, whatever the data
    nodes = spots.select(F.row_number().over(order).alias("k"), "shard", F.lag("high", 1).over(order).alias("low"), "high")
    beyond = nodes.agg(F.max("k").alias("k"), F.min_by("shard", "k").alias("shard"), F.max("high").alias("low"))
    return nodes.unionByName(beyond.select((F.col("k") + 1).alias("k"), "shard", "low", F.lit(MOST).alias("high"))).select((F.col("k") - 1).alias("node"), "shard", "low", "high")


def cells(nodes: DataFrame) -> DataFrame:
    """The ring's intervals by the cells that they touch: at most as many as cells and nodes together."""
    cell = lambda c: F.shiftright(c, 64 - CELL_BITS)
    return nodes.select("node", "low", "high", F.explode(F.sequence(cell(F.coalesce("low", F.lit(LEAST))), cell(F.col("high")))).alias("cell"))


class Run(NamedTuple):
    """Rows of one node, from the `start`th to before the `end`th of a partition, that a shard takes from a slot on."""

    part: int
    node: int
    start: int
    end: int
    shard: int
    slot: int


def take(counts: list[tuple[int, int, int]], owners: list[int], shards: int) -> list[Run]:
    """Which rows each shard takes. counts: partition, node and number of rows in ring order; owners: each node's shard."""
    total = sum(n for _, _, n in counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, left, at = [0] * shards, [], {}
    for part, node, n in counts:
        left.append((part, node, at.get(part, 0), at.get(part, 0) + n))
        at[part] = at.get(part, 0) + n
    out, step = [], 0
    while left:
        rest = []
        for part, node, low, high in left:
            shard = owners[(node + step) % len(owners)]
            if taken := min(high - low, room[shard] - filled[shard]):
                out.append(Run(part, node, low, low + taken, shard, filled[shard]))
                filled[shard] += taken
            if low + taken < high:
                rest.append((part, node, low + taken, high))
        left, step = rest, step + 1
    return out


def assign(docs: DataFrame, path: str, shards: int = 8, points: int = 512, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id, size (bytes of the text and one), text_crc32, shard and slot (from 0 in each shard), and the kept columns.
    path: a new folder that all executors reach, for the rows in the order of the ring."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    kept = F.struct(*(F.col(c) for c in keep if c not in (key, *RESULT)), F.lit(0).alias("no_other"))
    rows = docs.select(
        F.col(key).alias("key"), kept.alias("kept"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit("text"), text).alias("place"), F.monotonically_increasing_id().alias("salt"),
    )
    rows = stored(rows, path + "/places")  # from here on the salt stays as it is
    order = ["place", "key", "salt"]
    nodes = ring(spark, shards, points)
    lookup = cells(nodes).withColumnRenamed("cell", "c")
    inside = (F.shiftright("place", 64 - CELL_BITS) == F.col("c")) & (F.col("place") <= F.col("high")) & (F.col("low").isNull() | (F.col("place") > F.col("low")))
    with released(spark):
        numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        placed = numbered.join(F.broadcast(lookup), inside).withColumn("part", F.shiftright("at", PART_BITS)).withColumn("at", F.col("at").bitwiseAND((1 << PART_BITS) - 1))
        placed = stored(placed.select("key", "kept", "size", "text_crc32", "part", "node", "at"), path + "/places-in-order")
    owners = [r.shard for r in nodes.orderBy("node").collect()]
    counts = sorted((r.part, r.node, r["count"]) for r in placed.groupBy("part", "node").count().collect())
    runs = [r._asdict() for r in take(counts, owners[:-1], shards)]
    fields = "array<struct<part: long, node: int, start: long, end: long, shard: int, slot: long>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(runs)), fields))).withColumnsRenamed({"part": "p", "node": "k"})
    mine = (F.col("part") == F.col("p")) & (F.col("node") == F.col("k")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))
    out = placed.join(F.broadcast(table), mine).select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("slot") + F.col("at") - F.col("start")).alias("slot"), "kept.*")
    return out.drop("no_other")


def write(assigned: DataFrame, path: str) -> None:
    """The shards as Parquet folders, each file a range of slots in order."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
