"""The structure of a directed graph: strongly connected components, one cycle of each, and an order that cycles do not stop.

Edges are from_id and to_id of any one type that has an order; null ends and repeated edges are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.fixpoint import settle, spread
from tessera.operators.lineage import cut, discard


def plain_edges(edges: DataFrame) -> DataFrame:
    """a, b of each edge once."""
    return edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()


def weak_components(e: DataFrame) -> DataFrame:
    """id and component, the same node for all that edges a, b connect either way, of every node; e is a table that cut() has written.

    Each round a node joins the one that comes first, in an order of the round's own, of itself and those beside it, and nodes that
    joined the same one are one node from then on. So each round has a fraction of the edges of the one before it."""
    joined, rest = [], e
    while not joined or not rest.isEmpty():
        turn = F.lit(len(joined))
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(F.xxhash64("b", turn).alias("at"), F.col("b").alias("n"))).alias("first"))
        joined.append(cut(first.select("id", F.least("first", F.struct(F.xxhash64("id", turn).alias("at"), F.col("id").alias("n")))["n"].alias("component"))))
        left, right = (joined[-1].select(F.col("id").alias(f"{c}_id"), F.col("component").alias(f"{c}_of")) for c in ("a", "b"))
        among = rest.join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id"))
        later = cut(among.select(F.least("a_of", "b_of").alias("a"), F.greatest("a_of", "b_of").alias("b")).filter("a <> b").distinct())
        if rest is not e:
            discard(rest)
        rest = later
    discard(rest)
    out = joined.pop()
    while joined:
        before = joined.pop()
        ends = out.select(F.col("id").alias("x"), F.col("component").alias("end"))
        whole = cut(before.join(ends, F.col("component") == F.col("x"), "left").select("id", F.coalesce("end", "component").alias("component")))
        discard(before)
        discard(out)
        out = whole
    return out


def _trimmed(e: DataFrame, passes: int = 3) -> DataFrame:
    """Edges that are left when those that start where none ends, or end where none starts, have gone again and again."""
    while True:
        left = e
        for _ in range(passes):
            entered, left_by = (left.select(F.col(c).alias("x")).distinct().hint("merge") for c in ("b", "a"))  # a join has no hint itself
            left = left.join(entered, F.col("a") == F.col("x"), "left_semi").join(left_by, F.col("b") == F.col("x"), "left_semi")
        left = cut(left)
        if left.count() == e.count():
            discard(left)
            return e
        discard(e)
        e = left


def strong_components(edges: DataFrame) -> DataFrame:
    """id and component, the least node of its strongly connected component, of every node.

    Forward-backward colouring: each node takes the least node that reaches it as its colour; what reaches the colour's own node
    within the colour is its component. No component has edges of two colours, so these go with the components found, and what
    is left is trimmed and coloured again."""
    all_edges = cut(plain_edges(edges))
    nodes = all_edges.select(F.col("a").alias("id")).union(all_edges.select("b")).distinct()
    e, found = _trimmed(cut(all_edges.filter("a <> b"))), []
    while not e.isEmpty():
        ends = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
        forward = lambda s, e=e: s.join(e, F.col("id") == F.col("a")).select(F.col("b").alias("id"), "value")
        colour = settle(ends.withColumn("value", F.col("id")), forward)
        c = colour.select(F.col("id").alias("n"), F.col("value").alias("c"))
        inner = e.join(c, F.col("a") == F.col("n")).select("a", "b", F.col("c").alias("of"))
        inner = cut(inner.join(c, (F.col("b") == F.col("n")) & (F.col("of") == F.col("c"))).select("a", "b", "of"))
        back = lambda s, inner=inner: s.join(inner, (F.col("id") == F.col("b")) & (F.col("component") == F.col("of"))).select(F.col("a").alias("id"), "component")
        mine = spread(colour.filter("id = value").select("id", F.col("value").alias("component")), back)
        found.append(mine)
        done = mine.select(F.col("id").alias("x"))
        rest = inner.join(done, F.col("a") == F.col("x"), "left_anti").join(done, F.col("b") == F.col("x"), "left_anti").select("a", "b")
        e = _trimmed(cut(rest))
    out = nodes.withColumn("component", F.lit(None).cast(nodes.schema["id"].dataType))
    for f in found:
        out = out.unionByName(f)
    return cut(out.groupBy("id").agg(F.coalesce(F.max("component"), F.col("id")).alias("component")))


def _within(edges: DataFrame, components: DataFrame) -> DataFrame:
    """a, b and the component of the edges inside of components."""
    c = components.select(F.col("id").alias("n"), "component")
    half = plain_edges(edges).join(c, F.col("a") == F.col("n")).select("a", "b", F.col("component").alias("of"))
    return half.join(c, (F.col("b") == F.col("n")) & (F.col("of") == F.col("component"))).select("a", "b", "component")


def component_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """component and cycle: the shortest cycle through the least node of each component that has one, by least nodes from there on
    if there are several (T18). Of any length: distances to the least node settle, then each cycle is walked, one node a step."""
    inner = cut(_within(edges, components).filter("a <> b OR a = component"))
    back = lambda s: s.join(inner.filter("a <> b"), (F.col("id") == F.col("b")) & F.col("own").eqNullSafe(F.col("component"))).select(F.col("a").alias("id"), "own", (F.col("value") + 1).alias("value"))
    roots = inner.select(F.col("component").alias("id"), F.col("component").alias("own")).distinct()
    far = settle(roots.withColumn("value", F.lit(0)), back)
    to = far.select(F.col("id").alias("n"), F.col("own").alias("o"), "value")
    step = inner.join(to, (F.col("b") == F.col("n")) & (F.col("component") == F.col("o"))).groupBy("component", "a").agg(F.min(F.struct("value", "b")).alias("best"))
    step = cut(step.select(F.col("component").alias("of"), "a", F.col("best.b").alias("next")))
    walk = lambda s: s.join(step, (F.col("component") == F.col("of")) & (F.col("at") == F.col("a")) & ((F.col("k") == 0) | (F.col("at") != F.col("component")))).select("component", (F.col("k") + 1).alias("k"), F.col("next").alias("at"))
    walked = spread(roots.select(F.col("id").alias("component"), F.lit(0).alias("k"), F.col("id").alias("at")), walk)
    return walked.filter("k = 0 OR at <> component").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("k", "at")))["at"].alias("cycle"))


def condensed_order(edges: DataFrame, components: DataFrame) -> DataFrame:
    """id, component, level and last: a node's level is the longest way to its component over the graph of components, so that an
    order by level sets dependents behind what they come from; last holds for nodes on or behind a cycle, which an order that
    takes free nodes only would never reach (T19)."""
    c = components.select(F.col("id").alias("n"), "component")
    e = plain_edges(edges).join(c, F.col("a") == F.col("n")).select("a", "b", F.col("component").alias("ca"))
    e = cut(e.join(c, F.col("b") == F.col("n")).select("ca", F.col("component").alias("cb"), (F.col("a") == F.col("b")).alias("own")).distinct())
    between = e.filter("ca <> cb").select("ca", "cb")
    tied = components.groupBy(F.col("component").alias("id")).agg((F.count(F.lit(1)) > 1).alias("tied"))
    start = tied.join(e.filter("own").select(F.col("ca").alias("x")).distinct(), F.col("id") == F.col("x"), "left").select("id", F.struct(F.lit(0).alias("level"), (F.col("tied") | F.col("x").isNotNull()).alias("last")).alias("value"))
    split = lambda f: start.select("id", F.col(f"value.{f}").alias("value"))
    onward = lambda grow: lambda s: s.join(between, F.col("id") == F.col("ca")).select(F.col("cb").alias("id"), grow(F.col("value")).alias("value"))
    level = settle(split("level"), onward(lambda v: v + 1), F.max).withColumnRenamed("value", "level")
    last = settle(split("last"), onward(lambda v: v), F.max).select(F.col("id").alias("i"), F.col("value").alias("last"))
    both = level.join(last, F.col("id") == F.col("i")).select(F.col("id").alias("x"), "level", "last")
    return components.join(both, F.col("component") == F.col("x")).select("id", "component", "level", "last")
