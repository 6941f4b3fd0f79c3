"""Property-graph operators: a small query language, bounded traversal, paths, cycles, levels and components."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.lineage import cut

CONDITION = re.compile(r"(\w+)\s*(>=|<=|!=|=|>|<|contains|starts_with|ends_with|matches)\s*('[^']*'|\"[^\"]*\"|\S+)", re.IGNORECASE)


@dataclass
class GraphQuery:
    """A parsed query: conjunctive conditions, one sort key, limit and offset (0: none)."""

    conditions: list[tuple[str, str, object]] = field(default_factory=list)
    order_by: str | None = None
    descending: bool = False
    limit: int = 0
    skip: int = 0


def _value(text: str) -> object:
    if text[0] in "'\"":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def parse(query: str) -> GraphQuery:
    """Parse `[WHERE c (AND c)*] [RETURN ...] [ORDER BY key [ASC|DESC]] [LIMIT n]`; what does not parse is left out."""
    out = GraphQuery()
    where = re.search(r"\bWHERE\s+(.*?)(?=\bRETURN\b|\bORDER\s+BY\b|\bLIMIT\b|$)", query, re.IGNORECASE | re.DOTALL)
    for part in re.split(r"\s+AND\s+", where[1], flags=re.IGNORECASE) if where else []:
        if m := CONDITION.match(part.strip()):
            out.conditions.append((m[1], m[2].lower(), _value(m[3])))
    if m := re.search(r"\bORDER\s+BY\s+(\w+)(?:\s+(ASC|DESC))?", query, re.IGNORECASE):
        out.order_by, out.descending = m[1], (m[2] or "").upper() == "DESC"
    if m := re.search(r"\bLIMIT\s+(\d+)", query, re.IGNORECASE):
        out.limit = int(m[1])
    return out


def _fits(kind: T.DataType, value: object) -> bool:
    """Whether a column of this type and a value can be compared."""
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return isinstance(kind, T.NumericType)


def _compiles(pattern: str) -> bool:
    """Whether a pattern is one of the dialect that it is run in."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def predicate(column: Column, op: str, value: object, kind: T.DataType) -> Column:
    """One condition on a column of this type. A missing attribute never matches; of a text and a number, only != holds; a
    pattern that does not compile matches nothing (G3 to G5)."""
    text = column.cast("string")
    if op in ("=", "!=", ">", "<", ">=", "<=") and not _fits(kind, value):
        return column.isNotNull() if op == "!=" else F.lit(False)
    if op == "matches" and not _compiles(str(value)):
        return F.lit(False)
    return F.coalesce(
        {
            "=": lambda: column == value, "!=": lambda: column != value, ">": lambda: column > value, "<": lambda: column < value,
            ">=": lambda: column >= value, "<=": lambda: column <= value, "contains": lambda: text.contains(str(value)),
            "starts_with": lambda: text.startswith(str(value)), "ends_with": lambda: text.endswith(str(value)), "matches": lambda: text.rlike(str(value)),
        }[op](),
        F.lit(False),
    )


def select_nodes(nodes: DataFrame, query: GraphQuery | str, tiebreak: str = "id") -> DataFrame:
    """Filter, sort (missing keys as 0), skip and limit."""
    q = parse(query) if isinstance(query, str) else query
    known = [predicate(F.col(f), op, v, nodes.schema[f].dataType) if f in nodes.columns else F.lit(False) for f, op, v in q.conditions]
    out = nodes.filter(reduce(lambda a, b: a & b, known)) if known else nodes
    if q.order_by or q.skip or q.limit:
        keys = []
        if q.order_by in nodes.columns:
            key = F.coalesce(F.col(q.order_by), F.lit(0).cast(nodes.schema[q.order_by].dataType))
            keys.append(key.desc() if q.descending else key.asc())
        out = out.orderBy(*keys, tiebreak)
    out = out.offset(q.skip) if q.skip else out
    return out.limit(q.limit) if q.limit else out


def filter_edges(edges: DataFrame, types: tuple[str, ...] | None = None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Edges of some types with a confidence between low and high, both included; a missing one counts as 1."""
    keep = F.coalesce("confidence", F.lit(1.0)).between(low, high)
    return edges.filter(keep & F.col("type").isin(*types) if types else keep)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among nodes: two semi joins."""
    ids = nodes.select("id")
    return edges.join(ids, F.col("from_id") == F.col("id"), "left_semi").join(ids, F.col("to_id") == F.col("id"), "left_semi")


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    """at and next of each step along edges: out, in or both ways."""
    steps = []
    if direction in ("out", "both"):
        steps.append(edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("next")))
    if direction in ("in", "both"):
        steps.append(edges.select(F.col("to_id").alias("at"), F.col("from_id").alias("next")))
    return reduce(DataFrame.unionByName, steps)


def traverse(edges: DataFrame, seeds: DataFrame, depth: int | None, direction: str = "out") -> DataFrame:
    """id and its least depth from seeds(id), at most `depth` hops, or all that can be reached (None).

    Each hop joins the frontier with the edges as they are, so that a small frontier filters them where they are read, and
    drops what was seen. From three hops on the oriented edges are written once."""
    step = _oriented(edges, direction)
    if depth is None or depth > 2:
        step = cut(step)
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier, d = seen, 0
    while depth is None or d < depth:
        d += 1
        reached = frontier.join(step, F.col("id") == F.col("at")).select(F.col("next").alias("id")).distinct()
        fresh = reached.join(seen.select(F.col("id").alias("old")).hint("merge"), F.col("id") == F.col("old"), "left_anti").withColumn("depth", F.lit(d))
        frontier = fresh if d == depth else cut(fresh)
        if depth is None and frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def closure(edges: DataFrame, seeds: DataFrame, direction: str = "out") -> DataFrame:
    """id and least depth of all that seeds reach, seeds included: to a fixpoint."""
    return traverse(edges, seeds, None, direction)


def between(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges on ways from starts to ends: both ends are reached from the one and reach the other."""
    inside = closure(edges, starts).select("id").join(closure(edges, ends, "in").select("id").hint("merge"), "id", "left_semi")
    return induced(cut(inside), edges)


def levels(edges: DataFrame) -> DataFrame:
    """id and level of each node: the length of the longest way that leads to it, null for nodes on or behind a cycle.

    Each round takes the nodes that no remaining edge enters, so that rounds are as many as the longest way has nodes."""
    left = cut(edges.select("from_id", "to_id").filter("from_id IS NOT NULL AND to_id IS NOT NULL").distinct())
    nodes = cut(left.select(F.col("from_id").alias("id")).union(left.select("to_id")).distinct())
    out, level = nodes.limit(0).withColumn("level", F.lit(0)), 0
    while True:
        free = cut(nodes.join(left.select(F.col("to_id").alias("t")), F.col("id") == F.col("t"), "left_anti"))
        if free.limit(1).count() == 0:
            return out.unionByName(nodes.withColumn("level", F.lit(None).cast("int")))
        gone = free.select(F.col("id").alias("g"))
        out = out.unionByName(free.withColumn("level", F.lit(level)))
        left = cut(left.join(gone, F.col("from_id") == F.col("g"), "left_anti"))
        nodes = cut(nodes.join(gone, F.col("id") == F.col("g"), "left_anti"))
        level += 1


def simple_paths(edges: DataFrame, longest: int, seeds: DataFrame | None = None) -> DataFrame:
    """path (array of ids) of every simple path of 1 to `longest` edges."""
    e = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()
    start = e if seeds is None else e.join(seeds, F.col("a") == F.col("id"), "left_semi")
    level = start.filter("a <> b").select(F.array("a", "b").alias("path"))
    out = level
    for _ in range(longest - 1):
        grown = level.join(e, F.element_at("path", -1) == F.col("a")).filter(~F.array_contains("path", F.col("b")))
        level = grown.select(F.concat("path", F.array("b")).alias("path"))
        out = out.unionByName(level)
    return out


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """Every cycle of 2 to `longest` nodes once, its least node first."""
    e = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()
    paths = simple_paths(edges, longest - 1).filter(F.array_min("path") == F.element_at("path", 1))
    closing = (F.element_at("path", -1) == F.col("a")) & (F.element_at("path", 1) == F.col("b"))
    return paths.join(e, closing, "left_semi")


def least_cost(edges: DataFrame, seeds: DataFrame, cost: Column, hops: int) -> DataFrame:
    """id and least total cost within so many hops: relaxation by rounds (T5)."""
    e = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), cost.alias("step"))
    best = seeds.select("id", F.lit(0.0).alias("cost"))
    for _ in range(hops):
        relaxed = best.join(e, F.col("id") == F.col("a")).select(F.col("b").alias("id"), (F.col("cost") + F.col("step")).alias("cost"))
        best = cut(best.unionByName(relaxed).groupBy("id").agg(F.min("cost").alias("cost")))
    return best


def components(edges: DataFrame) -> DataFrame:
    """id and the least id reachable either way: label propagation until nothing changes."""
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component"))
    while True:
        label = cut(label)
        near = both.join(label, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "component", F.lit(None).cast(label.schema["component"].dataType).alias("was"))
        moved = cut(label.withColumn("was", F.col("component")).unionByName(near).groupBy("id").agg(F.min("component").alias("component"), F.max("was").alias("was")))
        if moved.filter("component <> was").limit(1).count() == 0:
            return moved.select("id", "component")
        label = moved.select("id", "component")


def path_statistics(paths: DataFrame) -> DataFrame:
    """Number of paths of each length."""
    return paths.groupBy((F.size("path") - 1).alias("length")).agg(F.count(F.lit(1)).alias("n_paths"))


def path_score(length: Column, confidence: Column, weight: Column, satisfied: Column, violated: Column) -> Column:
    """Score of a constrained path."""
    return 0.3 / (1 + length) + 0.3 * confidence + 0.2 / (1 + weight) + 0.2 * satisfied / (satisfied + violated)
