"""Node metrics of a directed graph: degrees, closure sizes and betweenness by Brandes' method.

Edges are shuffled by weak component, and a task walks from the sources of whole components over flat arrays, so that no pair of a
node and what it reaches is a row. The sources of a component of many nodes and edges are dealt to several tasks, each with all
its edges, and one of more than LARGE edges, which no task should hold, goes in rounds with a row a pair."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.lineage import cut, discard, together
from tessera.operators.structure import plain_edges, weak_components

#: Edges up to which a component stays in one block, nodes times edges of a larger one for each block of its sources, most blocks.
SMALL, WORK, BLOCKS = 4096, 1 << 28, 64
#: Edges of a component up to which a task holds them.
LARGE = 1 << 21
#: Edges that the walks of a task follow at once, if they are of more than one source.
STEPS = 1 << 21


def _levels(e: DataFrame, sources: DataFrame, at_once: int) -> list[DataFrame]:
    """Tables of source, id, depth and paths (the number of shortest ways from the source), `at_once` depths in each."""
    tables = [cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")))]
    frontier, depth = tables[0], 0
    while True:
        new: list[DataFrame] = []
        for _ in range(at_once):
            depth += 1
            known = reduce(DataFrame.unionByName, [together(tables), *new]).select(F.col("source").alias("s"), F.col("id").alias("n"))
            reached = frontier.join(e, F.col("id") == F.col("a")).groupBy("source", F.col("b").alias("id")).agg(F.sum("paths").alias("paths"))
            frontier = reached.join(known, (F.col("source") == F.col("s")) & (F.col("id") == F.col("n")), "left_anti").select("source", "id", F.lit(depth).alias("depth"), "paths")
            new.append(frontier)
        table = cut(reduce(DataFrame.unionByName, new))
        if table.isEmpty():
            discard(table)
            return tables
        tables.append(table)
        frontier = table.filter(F.col("depth") == depth)


def _dependencies(e: DataFrame, tables: list[DataFrame], at_once: int) -> list[DataFrame]:
    """Tables of source, id, depth, paths and share: how much of the shortest ways from the source to others lead on through id.
    From the deepest level to the first: a node hands each one before it its own share and one, by the number of ways."""
    out, beyond = [], None
    for k in range(len(tables) - 1, 0, -1):
        new = []
        for depth in range(k * at_once, (k - 1) * at_once, -1):
            level = tables[k].filter(F.col("depth") == depth)
            if beyond is None:
                shared = level.withColumn("share", F.lit(0.0))
            else:
                later = beyond.select(F.col("source").alias("s"), F.col("id").alias("n"), ((F.col("share") + 1) / F.col("paths")).alias("each"))
                onward = level.join(e, F.col("id") == F.col("a")).join(later, (F.col("source") == F.col("s")) & (F.col("b") == F.col("n")))
                handed = onward.groupBy(F.col("source").alias("s"), F.col("id").alias("n")).agg(F.sum(F.col("paths") * F.col("each")).alias("share"))
                shared = level.join(handed, (F.col("source") == F.col("s")) & (F.col("id") == F.col("n")), "left").select("source", "id", "depth", "paths", F.coalesce("share", F.lit(0.0)).alias("share"))
            new.append(shared)
            beyond = shared
        out.append(cut(reduce(DataFrame.unionByName, new)))
        beyond = out[-1].filter(F.col("depth") == (k - 1) * at_once + 1)
    return out


def _walks(first: np.ndarray, b: np.ndarray, sources: np.ndarray, steps: int) -> tuple[int, list[np.ndarray]] | None:
    """The number of edges followed, and reachable, dependents and share of each node by all shortest ways from sources; None if they
    follow more than `steps` edges and are of several sources. Node x has edges to b[first[x]:first[x + 1]]."""
    n, met = len(first) - 1, 0
    of, node, paths = np.arange(len(sources)), sources, np.ones(len(sources))
    levels, links, known = [(of, node, paths)], [], [of * n + node]
    while len(node):
        degree = first[node + 1] - first[node]
        met += int(degree.sum())
        if met > steps and len(sources) > 1:
            return None
        origin = np.repeat(np.arange(len(node)), degree)
        there = of[origin] * n + b[np.arange(len(origin)) + np.repeat(first[node] - np.cumsum(degree) + degree, degree)]
        for run in known:
            new = run[np.minimum(np.searchsorted(run, there), len(run) - 1)] != there
            origin, there = origin[new], there[new]
        there, target = np.unique(there, return_inverse=True)
        paths = np.bincount(target, paths[origin], len(there))
        of, node = np.divmod(there, n)
        levels.append((of, node, paths))
        links.append((origin, target))
        known.append(there)
        while len(known) > 1 and 2 * len(known[-1]) > len(known[-2]):  # few sorted runs, so that a look-up is cheap at any depth
            known[-2:] = [np.sort(np.concatenate(known[-2:]), kind="stable")]
    shares = [np.zeros(0)]
    for k in range(len(links) - 1, -1, -1):
        (origin, target), before, ways, share = links[k], levels[k][2], levels[k + 1][2], shares[-1]
        shares.append(np.bincount(origin, before[origin] / ways[target] * (1 + share[target]), len(before)))
    of, node = (np.concatenate([level[i] for level in levels[1:]]) for i in (0, 1))
    through = np.concatenate(shares[-2::-1])
    return met, [np.bincount(sources[of], minlength=n), np.bincount(node, minlength=n), np.bincount(node, through, n)]


def _solve(table: pa.Table, steps: int) -> pa.Table:
    """id, reachable, dependents and share of the nodes of whole blocks of components, by the sources of the blocks."""
    begin = np.r_[0, np.flatnonzero(_changes(table)) + 1]
    group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(table)]))
    ends = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks().dictionary_encode()
    size, codes = len(ends.dictionary), ends.indices.to_numpy().astype(np.int64)
    nodes, both = np.unique(np.r_[group, group] * size + codes, return_inverse=True)  # blocks of one component share no nodes here
    a, b = both[: len(group)], both[len(group) :]
    b, first, part = b[np.argsort(a, kind="stable")], np.r_[0, np.cumsum(np.bincount(a, minlength=len(nodes)))], nodes // size
    block, blocks = (table.column(c).to_numpy()[begin][part] for c in ("block", "blocks"))
    sources = np.flatnonzero((np.arange(len(nodes)) - np.searchsorted(part, part)) % blocks == block)  # all blocks have the nodes in one order
    sums = [np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), np.zeros(len(nodes))]
    at, many = 0, len(sources)
    while at < len(sources):
        mine = sources[at : at + many]
        walked = _walks(first, b, mine, steps)
        if walked is None:
            many = (len(mine) + 1) // 2
            continue
        for total, more in zip(sums, walked[1], strict=True):
            total += more
        at, many = at + many, 2 * many if 4 * walked[0] < steps else many
    return pa.table([ends.dictionary.take(pa.array(nodes % size)), *map(pa.array, sums)], names=["id", "reachable", "dependents", "share"])


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row is of another block or component than the row before it, without the first row."""
    other = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)) for c in (table.column("component").combine_chunks(), table.column("block").combine_chunks())]
    return pc.or_(*other).to_numpy(zero_copy_only=False).astype(bool)


def _in_tasks(e: DataFrame, steps: int, at_least: int = 8192) -> DataFrame:
    """id, reachable, dependents and share by block, of edges a, b with component, block and blocks."""
    ids = e.schema["a"].dataType
    schema = T.StructType([T.StructField("id", ids), T.StructField("reachable", T.LongType()), T.StructField("dependents", T.LongType()), T.StructField("share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            seam = pa.Table.from_batches([*(h.slice(h.num_rows - 1) for h in held[-1:]), batch])
            cuts = np.flatnonzero(_changes(seam)) + (0 if held else 1)  # rows of the batch that begin a block
            if len(cuts) and sum(h.num_rows for h in held) + int(cuts[-1]) >= at_least:
                yield from _solve(pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))]), steps).to_batches()
                held, batch = [], batch.slice(int(cuts[-1]))
            held.append(batch)
        if held:
            yield from _solve(pa.Table.from_batches(held), steps).to_batches()

    n = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return e.repartition(n, "component", "block").sortWithinPartitions("component", "block", "a", "b").mapInArrow(run, schema)


def _in_rounds(e: DataFrame, nodes: DataFrame, batches: int, at_once: int) -> list[DataFrame]:
    """Tables of id, reachable, dependents and share by batch of sources."""
    sums = []
    for batch in range(batches):
        levels = _levels(e, nodes.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == batch), at_once)
        if len(levels) == 1:
            continue
        shares = _dependencies(e, levels, at_once)
        pairs = together(shares)
        ends = pairs.select("id", F.lit(0).alias("reachable"), F.lit(1).alias("dependents"), "share").unionByName(pairs.select(F.col("source").alias("id"), F.lit(1).alias("reachable"), F.lit(0).alias("dependents"), F.lit(0.0).alias("share")))
        sums.append(cut(ends.groupBy("id").agg(F.sum("reachable").alias("reachable"), F.sum("dependents").alias("dependents"), F.sum("share").alias("share"))))
        for table in levels + shares:
            discard(table)
    return sums


def node_metrics(edges: DataFrame, batches: int = 1, at_once: int = 3) -> DataFrame:
    """id, in_degree, out_degree, reachable (nodes that it reaches), dependents (nodes that reach it) and betweenness, scaled as
    for a directed graph by the pairs of other nodes. Loops and repeated edges do not count.

    Components of more than LARGE edges: the state is one row for each source and node that it reaches, of one batch of sources at
    a time; its tables go once the batch is summed up."""
    e = cut(plain_edges(edges).filter("a <> b"))
    nodes = weak_components(e)
    where = nodes.select(F.col("id").alias("x"), "component")
    e_of = cut(e.join(where, F.col("a") == F.col("x")).select("a", "b", "component"))
    sizes = cut(e_of.groupBy(F.col("component").alias("of")).agg(F.count(F.lit(1)).alias("n_edges")).filter(F.col("n_edges") > SMALL))
    e_in, large = e_of.withColumn("blocks", F.lit(1)), None
    if not sizes.isEmpty():
        held = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes")).join(sizes, F.col("component") == F.col("of")).select("of", "n_edges", "n_nodes")
        blocks = F.least(F.ceil(F.coalesce(F.col("n_edges") * F.col("n_nodes"), F.lit(1)) / WORK), F.lit(BLOCKS)).cast("int")
        e_in = e_of.join(held, F.col("component") == F.col("of"), "left").filter(f"n_edges IS NULL OR n_edges <= {LARGE}").select("a", "b", "component", blocks.alias("blocks"))
        large = sizes.filter(F.col("n_edges") > LARGE).select("of")
    e_in = e_in.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sums = [cut(_in_tasks(e_in, STEPS).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("reachable", "dependents", "share"))))]
    if large is not None and not large.isEmpty():
        sums += _in_rounds(*(cut(df.join(large, F.col("component") == F.col("of"), "left_semi").drop("component")) for df in (e_of, nodes)), batches, at_once)
    degree = e.select(F.col("a").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("b").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    null = F.lit(None)
    rows = degree.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).select("*", null.cast("long").alias("reachable"), null.cast("long").alias("dependents"), null.cast("double").alias("share"))
    for s in sums:
        rows = rows.unionByName(s, allowMissingColumns=True)
    n = nodes.count()
    pairs_of_others = float(max(1, (n - 1) * (n - 2)))
    return rows.groupBy("id").agg(
        F.max("in_degree").alias("in_degree"), F.max("out_degree").alias("out_degree"), F.sum("reachable").alias("reachable"), F.sum("dependents").alias("dependents"),
        (F.sum("share") / pairs_of_others).alias("betweenness"),
    )
