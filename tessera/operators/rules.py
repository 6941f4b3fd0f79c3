"""Traversal and paths under rules: boundaries, filters and weights as columns, with priorities.

Nodes have id and any attributes; edges from_id, to_id and any attributes. Edges that start at no node of `nodes` are left out,
as are those with a null end. A start that is no node gives no row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.lineage import cut, together

Condition = str | Column | Callable[[list[str]], Column]
BOUNDARY, FILTER, WEIGHT = "boundary", "filter", "weight"


@dataclass(frozen=True)
class Rule:
    """boundary: nodes that are not walked on from; filter: edges that are not walked; weight: a factor of an edge's cost.
    condition: SQL or a column over the node's or edge's attributes, or a function from their names to a column."""

    name: str
    kind: str
    condition: Condition
    priority: int = 0
    enabled: bool = True

    def column(self, names: list[str]) -> Column:
        """The condition over a table with these columns."""
        if isinstance(self.condition, str):
            return F.expr(self.condition)
        return self.condition(names) if callable(self.condition) else self.condition


def _attribute(name: str, default: object) -> Callable[[list[str]], Column]:
    return lambda names: F.coalesce(F.col(name), F.lit(default)) if name in names else F.lit(default)


BUILTIN = {
    "skip_external": Rule("skip_external", BOUNDARY, lambda n: _attribute("module", "")(n).isin("external", "unknown")),
    "skip_tests": Rule("skip_tests", FILTER, "contains(lower(to_id), 'test')"),
    "skip_private": Rule("skip_private", FILTER, "contains(to_id, '::_') AND NOT contains(to_id, '::__')"),
    "complexity_weight": Rule("complexity_weight", WEIGHT, lambda n: 1.0 / F.greatest(_attribute("complexity", 1)(n), F.lit(1))),
    "confidence_weight": Rule("confidence_weight", WEIGHT, _attribute("confidence", 1.0)),
}


class Rules:
    """Rules by name; of several that hold, the one with the highest priority counts, then the one added first."""

    def __init__(self, *builtin: str) -> None:
        self._rules: dict[str, Rule] = {}
        for name in builtin:
            self.add_builtin(name)

    def add(self, name: str, kind: str, condition: Condition, priority: int = 0) -> None:
        """A rule, in place of one of the same name."""
        self._rules[name] = Rule(name, kind, condition, priority)

    def add_builtin(self, name: str) -> bool:
        """One of BUILTIN; whether there is one of this name."""
        if name in BUILTIN:
            self._rules[name] = BUILTIN[name]
        return name in BUILTIN

    def remove(self, name: str) -> bool:
        """Whether there was a rule of this name."""
        return self._rules.pop(name, None) is not None

    def enable(self, name: str, on: bool = True) -> bool:
        """Whether there is a rule of this name."""
        if name in self._rules:
            self._rules[name] = replace(self._rules[name], enabled=on)
        return name in self._rules

    def all(self) -> list[Rule]:
        """All rules by priority."""
        return sorted(self._rules.values(), key=lambda r: -r.priority)

    def active(self, kind: str, names: Sequence[str] | None = None) -> list[Rule]:
        """The enabled rules of a kind by priority, of these names only if any are given."""
        return [r for r in self.all() if r.enabled and r.kind == kind and (names is None or r.name in names)]


def _first(rules: list[Rule], names: list[str]) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*(F.when(r.column(names), r.name) for r in rules), F.lit(None).cast("string"))


def compiled(nodes: DataFrame, edges: DataFrame, rules: Rules, names: Sequence[str] | None = None, direction: str = "out") -> tuple[DataFrame, DataFrame]:
    """Steps: at, next, cost (the product of the weight rules, 1 without one), dropped (the filter rule that holds), attributes
    (the edge's); and stops: id and stopped (the boundary rule that holds) of the nodes that are not walked on from."""
    weights = [F.coalesce(r.column(edges.columns).cast("double"), F.lit(1.0)) for r in rules.active(WEIGHT, names)]
    made = edges.filter("from_id IS NOT NULL AND to_id IS NOT NULL").select(
        "from_id", "to_id", reduce(mul, weights, F.lit(1.0)).alias("cost"), _first(rules.active(FILTER, names), edges.columns).alias("dropped"),
        F.struct(*(F.col(c) for c in edges.columns)).alias("attributes"),
    )
    out = made.select(F.col("from_id").alias("at"), F.col("to_id").alias("next"), "cost", "dropped", "attributes")
    back = made.select(F.col("to_id").alias("at"), F.col("from_id").alias("next"), "cost", "dropped", "attributes")
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    steps = steps.join(nodes.select(F.col("id").alias("known")).distinct(), F.col("at") == F.col("known"), "left_semi")
    stops = nodes.select("id", _first(rules.active(BOUNDARY, names), nodes.columns).alias("stopped")).filter("stopped IS NOT NULL")
    return steps, stops


def weighted_traverse(steps: DataFrame, stops: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, id, weight, depth and stopped: the least total cost of a way of at most `depth` steps from each start, and the steps
    of the shortest such way (T5). Costs must not be negative. Each round relaxes the edges of nodes that the last one improved.
    starts: id."""
    walk = cut(steps.filter("dropped IS NULL").groupBy("at", "next").agg(F.min("cost").alias("cost")))
    closed = stops.select(F.col("id").alias("closed"))
    best = cut(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("label", F.struct(F.lit(0.0).alias("weight"), F.lit(0).alias("depth"))))
    for d in range(1, depth + 1):
        fresh = best.filter(F.col("label.depth") == d - 1).join(closed, F.col("id") == F.col("closed"), "left_anti")
        reached = fresh.join(walk, F.col("id") == F.col("at")).select("start", F.col("next").alias("id"), F.struct((F.col("label.weight") + F.col("cost")).alias("weight"), F.lit(d).alias("depth")).alias("label"))
        best = cut(best.unionByName(reached).groupBy("start", "id").agg(F.min("label").alias("label")))
        if best.filter(F.col("label.depth") == d).isEmpty():
            break
    found = best.join(stops.select(F.col("id").alias("closed"), "stopped"), F.col("id") == F.col("closed"), "left")
    return found.select("start", "id", "label.weight", "label.depth", "stopped")


def activations(steps: DataFrame, visited: DataFrame, depth: int) -> DataFrame:
    """start, rule and times: nodes that a boundary rule stopped, and edges from the nodes walked on from that a filter rule dropped
    (T4). visited: from weighted_traverse."""
    stopped = visited.filter("stopped IS NOT NULL").select("start", F.col("stopped").alias("rule"))
    walked = visited.filter((F.col("depth") < depth) & F.col("stopped").isNull())
    dropped = steps.filter("dropped IS NOT NULL").select("at", F.col("dropped").alias("rule"))
    edges = walked.join(dropped, F.col("id") == F.col("at")).select("start", "rule")
    return stopped.unionByName(edges).groupBy("start", "rule").agg(F.count(F.lit(1)).alias("times"))


@dataclass(frozen=True)
class Alike:
    """The pairs of starts (start, key) and ends (end, key) of equal keys. As keys may be shared by many, a pair is formed only where
    a way leads from its start to its end."""

    starts: DataFrame
    ends: DataFrame

    def on_ways(self, rest: DataFrame) -> DataFrame:
        """start and end of the pairs. rest: from _remaining."""
        a = self.starts.select("start", F.col("key").alias("start_key"))
        b = self.ends.select("end", F.col("key").alias("end_key"))
        met = rest.select(F.col("n").alias("start"), F.col("to").alias("end"))
        return met.join(a, "start").join(b, "end").filter("start_key = end_key").select("start", "end")


def _remaining(walk: DataFrame, stops: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """end, id and the least cost from id to the end within `depth` steps, which no way to it undercuts."""
    back = walk.select(F.col("next").alias("at"), F.col("at").alias("next"), "cost", "dropped")
    # a boundary node may be the end of a way, and is one's start if at all; no way leads through it
    inner = back.join(stops.select(F.col("id").alias("closed")), F.col("at") == F.col("closed"), "left_anti")
    first = back.join(ends.select("id"), F.col("at") == F.col("id"), "left_semi")
    whole = inner.unionByName(first).distinct()
    open_ends = weighted_traverse(whole, stops.limit(0), ends, depth)
    return open_ends.select(F.col("start").alias("to"), F.col("id").alias("n"), F.col("weight").alias("rest"))


def _ways(steps: DataFrame, stops: DataFrame, pairs: DataFrame | Alike, depth: int, best: int | None) -> DataFrame:
    """start, end, path, edges and weight of the simple ways of at most `depth` steps between the pairs (start, end); with `best`,
    no fewer than the so many cheapest of each pair.

    Ways grow by one step a round, written each time. One that cannot reach its end is dropped, and so is one that, with the
    least cost of what remains, comes out above the worst of as many complete ways as are asked for."""
    walk = cut(steps.filter("dropped IS NULL").select("at", "next", "cost", "attributes", F.lit(None).cast("string").alias("dropped")))
    closed = stops.select(F.col("id").alias("closed"))
    ends = pairs.ends if isinstance(pairs, Alike) else pairs
    rest = cut(_remaining(walk, stops, ends.select(F.col("end").alias("id")).distinct(), depth))
    pairs = pairs.on_ways(rest) if isinstance(pairs, Alike) else pairs
    edge = walk.schema["attributes"].dataType
    begin = cut(pairs.select("start", "end").distinct()).withColumns({"at": F.col("start"), "path": F.array("start"), "edges": F.array().cast(f"array<{edge.simpleString()}>"), "weight": F.lit(0.0)})
    done = [cut(begin.filter("start = end"))]
    open_ways = begin.filter("start <> end")
    joined = walk.select(F.col("at").alias("w_at"), "next", "cost", "attributes")
    for d in range(depth):
        grown = open_ways.join(joined, (F.col("at") == F.col("w_at")) & ~F.array_contains("path", F.col("next")))
        grown = grown.select("start", "end", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"), F.concat("edges", F.array("attributes")).alias("edges"), (F.col("weight") + F.col("cost")).alias("weight"))
        grown = grown.join(rest, (F.col("end") == F.col("to")) & (F.col("at") == F.col("n"))).drop("to", "n")
        if best is not None and d:
            worst = _ranked(together(done), best).filter(F.col("rank") == best).select(F.col("start").alias("s"), F.col("end").alias("e"), F.col("weight").alias("worst"))
            within = F.col("worst").isNull() | (F.col("weight") + F.col("rest") <= F.col("worst") * (1 + 1e-9))  # sums may differ in their last digits
            grown = grown.join(worst, (F.col("start") == F.col("s")) & (F.col("end") == F.col("e")), "left").filter(within).drop("s", "e", "worst")
        level = cut(grown.drop("rest"))
        if level.isEmpty():
            break
        done.append(cut(level.filter("at = end")))
        open_ways = level.filter("at <> end").join(closed, F.col("at") == F.col("closed"), "left_anti")
    return together(done).drop("at")


def _ranked(ways: DataFrame, best: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("start", "end").orderBy("weight", "path"))
    return ways.withColumn("rank", rank).filter(F.col("rank") <= best)


def best_paths(steps: DataFrame, stops: DataFrame, pairs: DataFrame | Alike, depth: int, best: int) -> DataFrame:
    """start, end, rank, path and weight of the `best` cheapest simple paths between each pair, equal ones by their nodes."""
    return _ranked(_ways(steps, stops, pairs, depth, best), best).select("start", "end", "rank", "path", "weight")


@dataclass(frozen=True)
class Constraints:
    """What a path must be like; custom ones are columns over path, types and edges, by name, with whether they are required."""

    min_length: int | None = None
    max_length: int | None = None
    must_visit: Sequence[str] = ()
    must_avoid: Sequence[str] = ()
    edge_types: Sequence[str] | None = None
    node_types: Sequence[str] | None = None
    min_confidence: float = 0.0
    max_weight: float | None = None
    pattern: str | None = None
    custom: dict[str, tuple[Condition, bool]] = field(default_factory=dict)


def _any_holds(part: str) -> Column:
    """Whether a node of the path contains the part."""
    return F.exists("path", lambda node: F.contains(node.cast("string"), F.lit(part)))


def _pattern(parts: list[str]) -> Column:
    """Whether the parts stand in the types of successive nodes, wherever it begins."""
    here = lambda k: reduce(and_, (F.contains(F.lower(F.get("types", k + i)), F.lit(p.lower())) for i, p in enumerate(parts)))
    starts = F.sequence(F.lit(0), F.size("types") - len(parts))
    return (F.size("types") >= len(parts)) & F.exists(F.when(F.size("types") >= len(parts), starts).otherwise(F.array(F.lit(0))), here)


def constrained_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame | Alike, want: Constraints, max_paths: int = 10, max_depth: int = 20) -> DataFrame:
    """start, end, rank, path, length, weight, confidence (the mean), satisfied, violated (names of constraints) and score of the
    paths of each pair that meet the constraints, the best ones by score and then by nodes (T9, T11 to T13).

    Edges without a type count as unknown, without a confidence or weight as 1; so do nodes without a type. Nodes to avoid,
    node types and edge types are looked at before paths grow; what depends on a whole path, after."""
    has = lambda df, c, default: _attribute(c, default)(df.columns)
    e = edges.select("from_id", "to_id", has(edges, "type", "unknown").alias("type"), has(edges, "confidence", 1.0).cast("double").alias("confidence"), has(edges, "weight", 1.0).cast("double").alias("weight"))
    n = cut(nodes.select("id", has(nodes, "type", "unknown").alias("type")).distinct())
    kinds = n.select(F.col("id").alias("k"), F.col("type").alias("node_type"))
    text = lambda c: F.col(c).cast("string")
    bad = lambda c: reduce(lambda a, b: a | b, (F.contains(text(c), F.lit(x)) for x in want.must_avoid), F.lit(False))
    typed = e.join(kinds, F.col("to_id") == F.col("k"), "left").withColumn("node_type", F.coalesce("node_type", F.lit("unknown"))).drop("k")
    typed = typed.filter(~bad("to_id"))
    start_kinds = n.select(F.col("id").alias("s"), F.col("type").alias("start_type"))
    if want.edge_types is not None:
        typed = typed.filter(F.col("type").isin(*want.edge_types))
    if want.node_types is not None:
        typed, start_kinds = typed.filter(F.col("node_type").isin(*want.node_types)), start_kinds.filter(F.col("start_type").isin(*want.node_types))
    begun = lambda df: df.filter(~bad("start")).join(start_kinds, F.col("start") == F.col("s"), "left_semi")
    known = lambda df: df.join(n.select(F.col("id").alias("known")), F.col("end") == F.col("known"), "left_semi")
    begins = Alike(begun(pairs.starts), known(pairs.ends)) if isinstance(pairs, Alike) else cut(known(begun(pairs)).select("start", "end").distinct())
    steps, stops = compiled(n, typed, Rules())
    depth = max_depth if want.max_length is None else min(max_depth, want.max_length)
    ways = _ways(steps, stops, begins, depth, None).join(start_kinds, F.col("start") == F.col("s"))
    plus = lambda name: F.aggregate("edges", F.lit(0.0), lambda a, x: a + x[name])
    length = F.size("path") - 1
    rows = ways.select("start", "end", "path", "edges", F.concat(F.array("start_type"), F.col("edges.node_type")).alias("types"), length.alias("length"), plus("weight").alias("weight"), (plus("confidence") / F.greatest(length, F.lit(1))).alias("confidence"))
    checks: list[tuple[str, Column, bool]] = []
    if want.min_length is not None:
        checks.append(("min_length", F.col("length") >= want.min_length, True))
    if want.max_length is not None:
        checks.append(("max_length", F.col("length") <= want.max_length, True))
    checks += [(f"must_visit:{x}", _any_holds(x), True) for x in want.must_visit]
    checks += [(f"must_avoid:{x}", F.lit(True), True) for x in want.must_avoid]
    checks += [(name, F.lit(True), True) for name, given in (("edge_types", want.edge_types), ("node_types", want.node_types)) if given is not None]
    checks.append(("min_confidence", F.col("confidence") >= want.min_confidence, True))
    if want.max_weight is not None:
        checks.append(("max_weight", F.col("weight") <= want.max_weight, True))
    if want.pattern:
        checks.append(("pattern", _pattern([p.strip() for p in want.pattern.split("->")]), True))
    checks += [(name, F.coalesce(Rule(name, "", c).column(rows.columns), F.lit(False)), required) for name, (c, required) in want.custom.items()]
    for _, holds, required in checks:
        rows = rows.filter(holds) if required else rows
    names = lambda yes: F.array_compact(F.array(*(F.when(holds if yes else ~holds, name) for name, holds, _ in checks)))
    rows = rows.withColumns({"satisfied": names(True), "violated": names(False)})
    met, missed = F.size("satisfied"), F.size("violated")
    score = 0.3 * (1.0 / (1.0 + F.col("length"))) + 0.3 * F.col("confidence") + 0.2 * (1.0 / (1.0 + F.col("weight"))) + 0.2 * (met / F.greatest(met + missed, F.lit(1)))
    scored = rows.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("start", "end").orderBy(F.desc("score"), "path"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= max_paths).select("start", "end", "rank", "path", "length", "weight", "confidence", "satisfied", "violated", "score")
