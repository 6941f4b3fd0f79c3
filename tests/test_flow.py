"""Data-flow analyses against walks over random flow graphs with loops."""

from __future__ import annotations

import random

import pytest

from tessera.operators import flow


@pytest.fixture(scope="module")
def programs():
    rng = random.Random(5)
    out = {}
    for proc in range(12):
        n = rng.randrange(1, 9)
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(n + 2)} | {(k, k + 1) for k in range(n - 1) if rng.random() < 0.8}
        out[proc] = n, edges, {(k, rng.choice("xyz")) for k in range(n) if rng.random() < 0.6}, {(k, rng.choice("xyz")) for k in range(n) if rng.random() < 0.6}
    return out


def ways(edges, starts, stop):
    """Nodes at the ends of ways of one edge or more that do not pass through a node where stop holds."""
    seen, queue = set(), list(starts)
    while queue:
        x = queue.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                if not stop(b):
                    queue.append(b)
    return seen


def rows(spark, programs, k, schema):
    return spark.createDataFrame([(proc, *x) for proc, p in programs.items() for x in p[k]] + [(None,) * (1 + len(schema.split(",")))] , "proc long, " + schema)


def test_against_walks(spark, programs):
    edges = rows(spark, programs, 1, "a long, b long")
    defs, uses = rows(spark, programs, 2, "node long, variable string"), rows(spark, programs, 3, "node long, variable string")
    got = {(r.proc, r.node, r.variable, r.definition) for r in flow.reaching_definitions(edges, defs).collect()}
    assert got == {(p, n, x, d) for p, (_, e, ds, _) in programs.items() for d, x in ds for n in ways(e, [d], lambda k, ds=ds, x=x: (k, x) in ds)}
    live = {
        (p, n, x) for p, (count, e, ds, us) in programs.items() for n in range(count) for x in "xyz"
        if any((m, x) in us for m in ways(e, [n], lambda k, ds=ds, x=x: (k, x) in ds))
    }
    assert {tuple(r) for r in flow.live_variables(edges, defs, uses).select("proc", "node", "variable").collect()} == live
    dead = {(p, n, x) for p, (_, _, ds, _) in programs.items() for n, x in ds} - live
    assert {tuple(r) for r in flow.dead_definitions(edges, defs, uses).collect()} == dead


def test_dominators_and_loops(spark, programs):
    edges = rows(spark, programs, 1, "a long, b long")
    entries = spark.createDataFrame([(p, 0) for p in programs], "proc long, node long")
    found = flow.dominators(edges, entries)
    want = {}
    for p, (count, e, _, _) in programs.items():
        reached = ways(e, [0], lambda k: False) | {0}
        for n in reached:
            want[p, n] = {d for d in range(count) if d == n or (d in reached and (d == 0 or n not in ways(e, [0], lambda k, d=d: k == d) | {0}))}
            if n == 0:
                want[p, n] = {0}
    got = {}
    for r in found.collect():
        got.setdefault((r.proc, r.node), set()).add(r.dominator)
    assert got == want
    nearest = {(r.proc, r.node): r.dominator for r in flow.immediate_dominators(found).collect()}
    assert nearest == {k: next(d for d in ds - {k[1]} if want[k[0], d] == ds - {k[1]}) for k, ds in want.items() if len(ds) > 1}
    bodies = {}
    for p, (_, e, _, _) in programs.items():
        for a, h in e:
            if (p, a) in want and h in want[p, a]:
                before = {(y, x) for x, y in e if (p, x) in want and y != h}
                bodies.setdefault((p, h), {h}).update({a} if a == h else {a} | ways(before, [a], lambda k, h=h: k == h))
    loops = {}
    for r in flow.natural_loops(edges, found).collect():
        loops.setdefault((r.proc, r.header), set()).add(r.node)
    assert loops == bodies


def all_results(spark, programs):
    edges, entries = rows(spark, programs, 1, "a long, b long"), spark.createDataFrame([(p, 0) for p in programs], "proc long, node long")
    defs, uses = rows(spark, programs, 2, "node long, variable string"), rows(spark, programs, 3, "node long, variable string")
    found = flow.dominators(edges, entries)
    frames = [flow.reaching_definitions(edges, defs, uses).select("proc", "node", "definition"), flow.live_variables(edges, defs, uses), flow.dead_definitions(edges, defs, uses), found, flow.natural_loops(edges, found), flow.loops(edges, entries)]
    return [sorted(map(tuple, f.collect())) for f in frames]


def no_rounds(*_, **__):
    raise AssertionError("rows of small procedures went in rounds")


def test_small_procedures_without_rounds(spark, programs, monkeypatch):
    """A chain of 12 nodes with a loop would take several rounds; a procedure that is large has the same results."""
    chain = {(k, k + 1) for k in range(11)} | {(11, 3)}
    mixed = {p: programs[p] for p in (1, 4, 7)} | {99: (12, chain, {(0, "x"), (6, "y")}, {(10, "x"), (2, "y")})}
    monkeypatch.setattr(flow, "SMALL", 12)  # only the chain has more rows, and goes in rounds
    split = all_results(spark, mixed)
    monkeypatch.setattr(flow, "SMALL", 256)
    monkeypatch.setattr(flow, "spread", no_rounds)
    assert all_results(spark, mixed) == split and split[4] == split[5]
    assert (99, 10, 0) in split[0] and (99, 2, 6) not in split[0]
    assert all(len(set(r)) == len(r) for r in split)
