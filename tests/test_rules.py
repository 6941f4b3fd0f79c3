"""Rules, weighted traversal, cheapest paths and constraints against plain walks over random graphs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import rules as r


def test_rule_management(spark):
    rules = r.Rules("skip_external", "no_such")
    assert [x.name for x in rules.all()] == ["skip_external"] and not rules.add_builtin("no_such")
    rules.add("low", r.FILTER, "confidence < 0.5", priority=1)
    rules.add("lower", r.FILTER, F.col("confidence") < 0.2, priority=5)
    assert [x.name for x in rules.active(r.FILTER)] == ["lower", "low"] and [x.name for x in rules.active(r.FILTER, ["low"])] == ["low"]
    assert rules.enable("lower", False) and not rules.enable("none") and [x.name for x in rules.active(r.FILTER)] == ["low"]
    assert rules.remove("low") and not rules.remove("low") and rules.active(r.FILTER) == []


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(13)
    nodes = {f"{'test_' if k % 9 == 8 else ''}n{k:02}": (rng.choice(["external", "core", "core"]), rng.choice(["function", "Class", "method"])) for k in range(18)}
    edges = [(a, b, rng.choice(["call", "import"]), rng.choice([0.25, 0.5, 1.0]), float(rng.randrange(1, 4))) for a in nodes for b in rng.sample(sorted(nodes), 2)]
    return nodes, edges


@pytest.fixture(scope="module")
def frames(spark, graph):
    nodes, edges = graph
    n = spark.createDataFrame([(k, m, t) for k, (m, t) in nodes.items()], "id string, module string, type string")
    return n, spark.createDataFrame([*edges, ("nowhere", "n00", "call", 1.0, 1.0), (None, "n00", "call", 1.0, 1.0)], "from_id string, to_id string, type string, confidence double, weight double")


def ways(edges, start, depth, through):
    """All simple ways (path, edges) from a start."""
    out, level = [((start,), ())], [((start,), ())]
    for _ in range(depth):
        level = [((*p, e[1]), (*es, e)) for p, es in level if len(p) == 1 or through(p[-1]) for e in edges if e[0] == p[-1] and e[1] not in p]
        out += level
    return out


def test_traversal_and_activations(spark, graph, frames):
    nodes, edges = graph
    rules = r.Rules("skip_external", "skip_tests", "confidence_weight")
    rules.add("double", r.WEIGHT, "weight")
    steps, stops = r.compiled(*frames, rules)
    depth = 4
    found = r.weighted_traverse(steps, stops, spark.createDataFrame([("n01",), ("n02",)], "id string"), depth).collect()
    for start in ("n01", "n02"):
        best, level = {start: (0.0, 0)}, {start: 0.0}
        for d in range(1, depth + 1):
            new = {}
            for a, w in level.items():
                if nodes[a][0] == "external":
                    continue
                for e in edges:
                    if e[0] == a and "test" not in e[1]:
                        new[e[1]] = min(new.get(e[1], math.inf), w + e[3] * e[4])
            level = new
            for k, w in new.items():
                best[k] = min(best.get(k, (math.inf, 0)), (w, d))
        assert {x.id: (x.weight, x.depth) for x in found if x.start == start} == best
        assert {x.id for x in found if x.start == start and x.stopped} == {k for k in best if nodes[k][0] == "external"}
    times = {(x.start, x.rule): x.times for x in r.activations(steps, spark.createDataFrame(found), depth).collect()}
    assert times["n01", "skip_external"] == sum(x.start == "n01" and x.stopped is not None for x in found)
    walked = [x.id for x in found if x.start == "n01" and not x.stopped and x.depth < depth]
    assert times.get(("n01", "skip_tests"), 0) == sum(e[0] in walked and "test" in e[1] for e in edges)


def test_best_paths(spark, graph, frames):
    nodes, edges = graph
    steps, stops = r.compiled(*frames, r.Rules("skip_external", "confidence_weight"))
    names = sorted(nodes)
    pairs = [(a, b) for a in names[:4] for b in names[:8]] + [("none", "n01")]
    got = r.best_paths(steps, stops, spark.createDataFrame(pairs, "start string, end string"), 5, 2).collect()
    want = {}
    for a, b in pairs:
        if a in nodes:
            all_ways = sorted((sum(e[3] for e in es), p) for p, es in ways(edges, a, 5, lambda x: nodes[x][0] != "external") if p[-1] == b and (len(p) == 1) == (a == b))
            want |= {(a, b, k + 1): (w, list(p)) for k, (w, p) in enumerate(all_ways[:2])}
    assert {(x.start, x.end, x.rank): (x.weight, x.path) for x in got if x.start != "none"} == want


def test_constraints(spark, graph, frames):
    nodes, edges = graph
    names = sorted(nodes)
    pairs = [(a, b) for a in names[:6] for b in names if a != b]
    want = r.Constraints(2, 4, ("n0",), ("n03",), ("call", "import"), None, 0.5, 7.0, "class -> meth", {"light": ("weight < 4", False), "odd": (F.size("path") > 0, True)})
    got = r.constrained_paths(*frames, spark.createDataFrame(pairs, "start string, end string"), want, max_paths=3).collect()
    kinds = {k: t.lower() for k, (_, t) in nodes.items()}
    expected = {}
    for a, b in pairs:
        scored = []
        for p, es in ways(edges, a, 4, lambda x: True):
            n = len(es)
            if p[-1] != b or not 2 <= n <= 4 or not any("n0" in x for x in p) or any("n03" in x for x in p):
                continue
            trust, weight = sum(e[3] for e in es) / n, sum(e[4] for e in es)
            if trust < 0.5 or weight > 7 or not any("class" in kinds[x] and "meth" in kinds[y] for x, y in zip(p, p[1:], strict=False)):
                continue
            met = 9 + (weight < 4)
            scored.append((-(0.3 / (1 + n) + 0.3 * trust + 0.2 / (1 + weight) + 0.2 * met / 10), p, ["light"] if weight >= 4 else []))
        for k, (s, p, missed) in enumerate(sorted(scored, key=lambda x: (round(x[0], 12), x[1]))[:3]):
            expected[a, b, k + 1] = (list(p), missed, round(-s, 9))
    assert expected and {(x.start, x.end, x.rank): (x.path, x.violated, round(x.score, 9)) for x in got} == expected
    assert all(x.satisfied[:3] == ["min_length", "max_length", "must_visit:n0"] and "min_confidence" in x.satisfied for x in got)


def test_pairs_of_a_key_only_where_ways_lead(spark, graph, frames, monkeypatch):
    """All nodes but one share a key; pairs are not written before ways are known, and the paths are those of the pairs."""
    nodes, _ = graph
    names = sorted(nodes)
    key = lambda x: None if x == "n07" else "k"
    starts, ends = names[:3], names[:12]
    alike = r.Alike(*(spark.createDataFrame([(x, key(x)) for x in xs], f"{c} string, key string") for c, xs in (("start", starts), ("end", ends))))
    lone = spark.createDataFrame([(f"lone{k}", "k") for k in range(500)], "end string, key string")
    steps, stops = r.compiled(*frames, r.Rules("skip_external", "confidence_weight"))
    explicit = spark.createDataFrame([(a, b) for a in starts for b in ends if key(a) and key(a) == key(b)], "start string, end string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    written, cut = [], r.cut
    monkeypatch.setattr(r, "cut", lambda df: written.append(out := cut(df)) or out)
    got = rows(r.best_paths(steps, stops, r.Alike(alike.starts, alike.ends.unionByName(lone)), 3, 2))
    assert max(t.count() for t in written if {"start", "end"} <= set(t.columns)) < 3 * len(names)
    assert got and got == rows(r.best_paths(steps, stops, explicit, 3, 2))
    want = r.Constraints(max_length=3, must_avoid=("n05",), node_types=("function", "Class"))
    score = lambda pairs: rows(r.constrained_paths(*frames, pairs, want).select("start", "end", "rank", "path"))
    assert score(alike) == score(explicit) != []
