"""Data-flow analyses over the flow edges of many procedures at once: reaching definitions, live variables, dominators, loops.

One driver serves them all: facts that a node makes run along the edges until a node kills them (P2, P20, P24, P25). Procedures of
at most SMALL rows are solved where they lie after one shuffle by procedure, a batch of them at once, so that nothing is shuffled
in rounds. In larger ones a fact is a row, so a hot variable or a large procedure is no large set anywhere, and each round handles
new rows only.

Edges are proc, a, b; nodes of different procedures never meet. Edges, definitions and uses with nulls are left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.fixpoint import spread
from tessera.operators.lineage import cut

#: Rows (edges and facts) up to which a procedure is solved in one batch; its facts times its edges are held at once.
SMALL = 256
EDGE, MADE, KILLED, ASKED = 1, 2, 4, 8  # what a row says of its procedure; one row may say several


def _ends(edges: DataFrame, back: bool = False) -> DataFrame:
    ends = ("b", "a") if back else ("a", "b")
    return edges.select("proc", F.col(ends[0]).alias("at"), F.col(ends[1]).alias("next")).na.drop()


def _on(*pairs: tuple[str, str]):
    out = F.lit(True)
    for left, right in pairs:
        out = out & (F.col(left) == F.col(right))
    return out


def _large(rows: DataFrame) -> DataFrame | None:
    """big: the procedures of more than SMALL rows, if there are any."""
    large = cut(rows.groupBy(F.col("proc").alias("big")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL).select("big"))
    return None if large.isEmpty() else large


def _of(df: DataFrame, large: DataFrame | None, how: str) -> DataFrame:
    return df if large is None else df.join(large, F.col("proc") == F.col("big"), how)


def _by_procedure(rows: DataFrame, solve: Callable[[pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """What solve makes of tables of whole procedures, each a batch and the rest of the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            proc = now.column("proc")
            starts = np.flatnonzero(pc.not_equal(proc.slice(1), proc.slice(0, len(proc) - 1)).to_numpy()) + 1
            whole = int(starts[-1]) if len(starts) else 0
            if whole:
                yield from solve(now.slice(0, whole)).to_batches()
            held = now.slice(whole)
        if held is not None and held.num_rows:
            yield from solve(held).to_batches()

    return rows.repartition("proc").sortWithinPartitions("proc").mapInArrow(run, schema)


def _codes(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Equal numbers for equal values in any of the columns, -1 for null."""
    whole = pa.chunked_array([chunk for c in columns for chunk in c.chunks], columns[0].type).combine_chunks()
    return pc.fill_null(whole.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row, in the order of the columns, and the number of each row's."""
    key = columns[0]
    for c in columns[1:]:
        key = key * (int(c.max(initial=0)) + 2) + c + 1
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return first, number


def _spans(group: np.ndarray, members: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in group and in members (group of each, sorted) of all pairs of equal group."""
    counts = np.bincount(members, minlength=groups)
    first = np.cumsum(counts) - counts
    n = counts[group]
    left = np.repeat(np.arange(len(group)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + first[group][left]


def _arrive(size: int, src: np.ndarray, dst: np.ndarray, leaving: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """Whether a fact enters each place, of places that it leaves at first and those that let it pass."""
    inside, leaving = np.zeros(size, bool), leaving.copy()
    while True:
        fired = leaving[src]
        hit = dst[fired]
        if not len(hit):
            return inside
        inside[hit] = True
        leaving[hit[passed[hit]]] = True
        src, dst = src[~fired], dst[~fired]


class _Nodes:
    """Numbers of procedures (rank) and of nodes in the order of procedures, from rows sorted by proc."""

    def __init__(self, t: pa.Table) -> None:
        self.n = t.num_rows
        proc = _codes([t.column("proc")])
        self.rank = np.cumsum(np.r_[False, proc[1:] != proc[:-1]])
        ends = _codes([t.column("node"), t.column("next")])
        both = np.r_[self.rank, self.rank]
        some = np.flatnonzero(ends >= 0)
        self.first, number = _numbered(both[some], ends[some])
        self.first = some[self.first]
        self.id = np.full(2 * self.n, -1)
        self.id[some] = number
        self.of = both[self.first]  # each node's procedure
        self.ranks = int(self.rank[-1]) + 1
        self.count = np.bincount(self.of, minlength=self.ranks)
        self.local = np.arange(len(self.of)) - (np.cumsum(self.count) - self.count)[self.of]

    def values(self, t: pa.Table, nodes: np.ndarray) -> pa.Array:
        whole = pa.chunked_array([*t.column("node").chunks, *t.column("next").chunks]).combine_chunks()
        return whole.take(pa.array(self.first[nodes]))


def _solve_facts(t: pa.Table, missed: bool, names: list[str]) -> pa.Table:
    """Facts that enter the nodes asked for (all, if none is asked) or, if `missed`, what is asked for and no fact of its key enters."""
    v = _Nodes(t)
    role, key, fact = t.column("role").to_numpy(), _codes([t.column("key")]), _codes([t.column("fact")])
    at, to = v.id[: v.n], v.id[v.n :]
    is_ = lambda what: np.flatnonzero(role & what)
    edge, made, killed, asked = is_(EDGE), is_(MADE), is_(KILLED), is_(ASKED)
    g_first, group = _numbered(v.rank, key)  # a key of a procedure
    f_first, f = _numbered(group[made], fact[made])
    f_row = made[f_first]
    f_group, f_rank = group[f_row], v.rank[f_row]
    size = v.count[f_rank]
    begin = np.cumsum(size) - size
    total = int(size.sum())
    leaving, passed = np.zeros(total, bool), np.ones(total, bool)
    leaving[begin[f] + v.local[at[made]]] = True
    order = killed[np.argsort(group[killed], kind="stable")]
    a, b = _spans(f_group, group[order], len(g_first))
    passed[begin[a] + v.local[at[order[b]]]] = False
    a, b = _spans(f_rank, v.rank[edge], v.ranks)
    inside = _arrive(total, begin[a] + v.local[at[edge[b]]], begin[a] + v.local[to[edge[b]]], leaving, passed)
    if len(asked):
        asked = asked[_numbered(group[asked], at[asked])[0]]
        by_group = np.argsort(f_group, kind="stable")
        q, b = _spans(group[asked], f_group[by_group], len(g_first))
        f_out = by_group[b]
        met = inside[begin[f_out] + v.local[at[asked[q]]]]
        if missed:
            rows = asked[np.bincount(q[met], minlength=len(asked)) == 0]
            return pa.table([t.column(c).take(pa.array(rows)) for c in ("proc", "node", "key")], names)
        f_out, nodes = f_out[met], at[asked[q[met]]]
    else:
        place = np.flatnonzero(inside)
        f_out = np.searchsorted(begin, place, "right") - 1
        nodes = (np.cumsum(v.count) - v.count)[f_rank[f_out]] + place - begin[f_out]
        if missed:
            f_out, nodes = f_out[:0], nodes[:0]
            return pa.table([t.column(c).take(pa.array(f_row[f_out])) for c in ("proc", "node", "key")], names)
    take = pa.array(f_row[f_out])
    return pa.table([t.column("proc").take(take), v.values(t, nodes), t.column("key").take(take), t.column("fact").take(take)], names)


def _solve_dominators(t: pa.Table, names: list[str], loops: bool = False) -> pa.Table:
    """proc, node, dominator and how many nodes dominate the dominator; with `loops`, proc, header, node of the loops. For each
    node d of a procedure, what ways without d arrive at."""
    v = _Nodes(t)
    role = t.column("role").to_numpy()
    at, to = v.id[: v.n], v.id[v.n :]
    edge, start = np.flatnonzero(role & EDGE), np.unique(at[np.flatnonzero(role & MADE)])
    nodes = len(v.of)
    entry = np.zeros(nodes, bool)
    entry[start] = True
    reached = entry | _arrive(nodes, at[edge], to[edge], entry, np.ones(nodes, bool))
    size = v.count[v.of]
    begin, total = np.cumsum(size) - size, int(size.sum())
    d = np.repeat(np.arange(nodes), size)  # the node that is avoided at each place, and the node it is a place of
    x = (np.cumsum(v.count) - v.count)[v.of[d]] + np.arange(total) - begin[d]
    leaving = entry[x] & (d != x)
    a, b = _spans(v.of, v.rank[edge], v.ranks)
    avoided = leaving | _arrive(total, begin[a] + v.local[at[edge[b]]], begin[a] + v.local[to[edge[b]]], leaving, d != x)
    dominates = reached[x] & reached[d] & ~(avoided & (d != x))
    if loops:
        back = edge[dominates[begin[to[edge]] + v.local[at[edge]]]]
        head, latch = np.zeros(nodes, bool), np.zeros(total, bool)
        head[to[back]] = True
        latch[begin[to[back]] + v.local[at[back]]] = True
        latch &= d != x
        kept = head[a] & reached[at[edge[b]]]
        a, b = a[kept], edge[b[kept]]
        body = latch | (head[d] & (d == x)) | _arrive(total, begin[a] + v.local[to[b]], begin[a] + v.local[at[b]], latch, d != x)
        found = np.flatnonzero(body)
        proc = t.column("proc").take(pa.array(v.first[d[found]] % v.n))
        return pa.table([proc, v.values(t, d[found]), v.values(t, x[found])], names)
    found = np.flatnonzero(dominates)
    depth = np.bincount(x[found], minlength=nodes)
    rows = pa.array(v.first % v.n)
    proc = t.column("proc").take(rows)
    return pa.table([proc.take(pa.array(x[found])), v.values(t, x[found]), v.values(t, d[found]), pa.array(depth[d[found]], pa.int64())], names)


def _rows(edges: DataFrame, facts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Edges and facts in one table; role tells what a row says."""
    first = facts[0][0]
    null = lambda c: F.lit(None).cast(first.schema[c].dataType if c in first.columns else "int")
    of = lambda df, c: F.col(c) if c in df.columns else null(c)
    e = edges.select("proc", F.col("at").alias("node"), "next", null("key").alias("key"), null("fact").alias("fact"), F.lit(EDGE).alias("role"))
    return reduce(DataFrame.unionByName, (df.select("proc", "node", F.lit(None).cast(edges.schema["next"].dataType).alias("next"), of(df, "key").alias("key"), of(df, "fact").alias("fact"), F.lit(role).alias("role")) for df, role in facts), e)


def entering(edges: DataFrame, facts: list[tuple[DataFrame, int]], missed: bool = False) -> DataFrame:
    """proc, node, key, fact: the facts that hold where a node is entered; with `missed`, proc, node, key of what is asked for and
    has none. facts: tables of proc, node, key, each with what it is. MADE: facts by node, with a column fact, in the first table
    only. KILLED: keys whose entering facts a node does not let through; what a node makes leaves it even if it kills the key.
    ASKED: where facts are asked for, if not everywhere. Edges as from _ends."""
    facts = [(df.select(*(c for c in ("proc", "node", "key", "fact") if c in df.columns)).na.drop(), role) for df, role in facts]
    rows = _rows(edges, facts)
    large = _large(rows)
    names = ["proc", "node", "key"] + ["fact"] * (not missed)
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in names])
    out = _by_procedure(_of(rows, large, "left_anti"), lambda t: _solve_facts(t, missed, names), schema)
    return out if large is None else out.unionByName(_entering_large(_of(edges, large, "left_semi"), [(_of(df, large, "left_semi"), role) for df, role in facts], missed))


def _entering_large(edges: DataFrame, facts: list[tuple[DataFrame, int]], missed: bool) -> DataFrame:
    """The same with a row for each fact, in rounds."""
    e = cut(edges.distinct()).withColumnRenamed("proc", "p")
    keys = lambda role, *names: reduce(DataFrame.unionByName, (df.select(F.col("proc").alias(names[0]), F.col("node").alias(names[1]), F.col("key").alias(names[2])) for df, r in facts if r & role)).distinct()
    along = lambda s: s.join(e, _on(("proc", "p"), ("node", "at"))).select("proc", F.col("next").alias("node"), "key", "fact")
    dead = cut(keys(KILLED, "kp", "kn", "kk")) if any(r & KILLED for _, r in facts) else None
    walked = lambda s: s if dead is None else s.join(dead, _on(("proc", "kp"), ("node", "kn"), ("key", "kk")), "left_anti")
    found = spread(along(facts[0][0]), lambda s: along(walked(s)))
    if not any(r & ASKED for _, r in facts):
        return found
    if missed:
        met = found.select(F.col("proc").alias("kp"), F.col("node").alias("kn"), F.col("key").alias("kk"))
        return keys(ASKED, "proc", "node", "key").join(met, _on(("proc", "kp"), ("node", "kn"), ("key", "kk")), "left_anti")
    return found.join(keys(ASKED, "ap", "an", "ak"), _on(("proc", "ap"), ("node", "an"), ("key", "ak")), "left_semi")


def _keyed(df: DataFrame, *more) -> DataFrame:
    return df.select("proc", "node", F.col("variable").alias("key"), *more)


def reaching_definitions(edges: DataFrame, definitions: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """proc, node, variable, definition: the nodes whose definition of a variable may still hold at a node; with `uses`, at the
    nodes that use the variable only. Both: proc, node, variable."""
    asked = [] if uses is None else [(_keyed(uses), ASKED)]
    found = entering(_ends(edges), [(_keyed(definitions, F.col("node").alias("fact")), MADE | KILLED), *asked])
    return found.select("proc", "node", F.col("key").alias("variable"), F.col("fact").alias("definition"))


def live_variables(edges: DataFrame, definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """proc, node, variable: variables that may be read after a node before they are defined again."""
    found = entering(_ends(edges, back=True), [(_keyed(uses, F.lit(0).alias("fact")), MADE), (_keyed(definitions), KILLED)])
    return found.select("proc", "node", F.col("key").alias("variable"))


def dead_definitions(edges: DataFrame, definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """proc, node, variable of the definitions that nothing reads."""
    found = entering(_ends(edges, back=True), [(_keyed(uses, F.lit(0).alias("fact")), MADE), (_keyed(definitions), KILLED | ASKED)], missed=True)
    return found.select("proc", "node", F.col("key").alias("variable"))


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """proc, node, dominator: the nodes that every way from the procedure's entry to a node meets, itself included; depth: how many
    dominators the dominator has. entries: proc, node, one for each procedure. Nodes that no way reaches have none.

    The fact that runs is its opposite: a way that has not met a node so far, which that node kills; one more fact that nothing
    kills tells the nodes that are reached at all."""
    small, schema, large = _by_entry(edges, entries, ["node", "dominator"], ["depth"])
    out = small(lambda t: _solve_dominators(t, schema.names))
    return out if large is None else out.unionByName(_dominators_large(*large))


def loops(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """proc, header, node: natural_loops of what dominators finds, without its rows for small procedures."""
    small, schema, large = _by_entry(edges, entries, ["header", "node"], [])
    out = small(lambda t: _solve_dominators(t, schema.names, loops=True))
    return out if large is None else out.unionByName(natural_loops(large[0], cut(_dominators_large(*large))))


def _by_entry(edges: DataFrame, entries: DataFrame, nodes: list[str], counts: list[str]) -> tuple[Callable, T.StructType, tuple[DataFrame, DataFrame] | None]:
    """What runs a solver on the small procedures, its result's schema, and edges and entries of the large ones, if any."""
    e, start = _ends(edges), entries.select("proc", "node").na.drop()
    rows = _rows(e, [(start, MADE)]).drop("key", "fact")
    large = _large(rows)
    schema = T.StructType([rows.schema["proc"], *(T.StructField(c, rows.schema["node"].dataType) for c in nodes), *(T.StructField(c, T.LongType()) for c in counts)])
    rest = None if large is None else (_of(e, large, "left_semi"), _of(start, large, "left_semi").distinct())
    return lambda solve: _by_procedure(_of(rows, large, "left_anti"), solve, schema), schema, rest


def _dominators_large(edges: DataFrame, start: DataFrame) -> DataFrame:
    """dominators with a row for each pair of nodes, in rounds."""
    e = cut(edges.distinct())
    nodes = cut(e.select("proc", F.col("at").alias("key")).union(e.select("proc", "next")).union(start).distinct())
    missing = start.withColumnRenamed("proc", "p").join(nodes, F.col("p") == F.col("proc")).filter("key <> node").select("proc", "node", "key")
    avoid = lambda df: df.withColumn("fact", F.lit(0))
    found = _entering_large(e, [(avoid(missing), MADE), (nodes.select("proc", F.col("key").alias("node"), "key"), KILLED)], False)
    reached = spread(start, lambda s: s.join(e.withColumnRenamed("proc", "p"), _on(("proc", "p"), ("node", "at"))).select("proc", F.col("next").alias("node")))
    avoided = found.join(start.select(F.col("proc").alias("p"), F.col("node").alias("s")), _on(("proc", "p"), ("node", "s")), "left_anti").unionByName(avoid(missing))
    avoided = avoided.filter("key <> node").select(F.col("proc").alias("ap"), F.col("node").alias("an"), F.col("key").alias("ak"))
    pairs = reached.join(reached.select(F.col("proc").alias("p"), F.col("node").alias("dominator")), F.col("proc") == F.col("p")).select("proc", "node", "dominator")
    found = cut(pairs.join(avoided, _on(("proc", "ap"), ("node", "an"), ("dominator", "ak")), "left_anti"))
    depth = found.groupBy(F.col("proc").alias("p"), F.col("node").alias("n")).agg(F.count(F.lit(1)).alias("depth"))
    return found.join(depth, _on(("proc", "p"), ("dominator", "n"))).select("proc", "node", "dominator", "depth")


def immediate_dominators(found: DataFrame) -> DataFrame:
    """proc, node, dominator: of a node's other dominators the one nearest to it, which has the most dominators itself; n: how many
    others there are. found: from dominators."""
    return found.filter("node <> dominator").groupBy("proc", "node").agg(F.max_by("dominator", "depth").alias("dominator"), F.count(F.lit(1)).alias("n"))


def natural_loops(edges: DataFrame, found: DataFrame) -> DataFrame:
    """proc, header, node: the bodies of loops, headers included. An edge back to a dominator closes a loop; its body are the nodes
    that reach the edge without the header. Loops of one header count as one. found: from dominators."""
    e = edges.select("proc", "at", "next") if "at" in edges.columns else _ends(edges)
    back = e.join(found.select(F.col("proc").alias("p"), "node", "dominator"), (F.col("proc") == F.col("p")) & (F.col("at") == F.col("node")) & (F.col("next") == F.col("dominator")))
    seeds = cut(back.select("proc", F.col("next").alias("header"), F.col("at").alias("node")).distinct())
    reached = found.filter("node = dominator").select(F.col("proc").alias("rp"), F.col("node").alias("rn"))
    looped = seeds.select(F.col("proc").alias("lp")).distinct()
    into = e.join(looped, F.col("proc") == F.col("lp"), "left_semi").join(reached, _on(("proc", "rp"), ("at", "rn")), "left_semi")
    into = cut(into.select("proc", F.col("next").alias("at"), F.col("at").alias("next")))
    inner = seeds.filter("node <> header").select("proc", "node", F.col("header").alias("key"), F.lit(0).alias("fact"))
    heads = seeds.select("proc", F.col("header").alias("node"), F.col("header").alias("key")).distinct()
    body = entering(into, [(inner, MADE), (heads, KILLED)]).select("proc", F.col("key").alias("header"), "node")
    return body.unionByName(seeds).unionByName(heads.select("proc", F.col("key").alias("header"), "node")).distinct()
