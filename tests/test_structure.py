"""Strong components, cycles and orders against plain versions on random graphs."""

from __future__ import annotations

import random
from collections import Counter, deque

from tessera.operators import centrality
from tessera.operators import structure as s
from tessera.operators.lineage import cut


def closure(edges):
    nodes = {x for e in edges for x in e}
    reach = {x: {b for a, b in edges if a == x} for x in nodes}
    while True:
        more = {x: r | set().union(*(reach[y] for y in r)) for x, r in reach.items()}
        if more == reach:
            return reach
        reach = more


def graph():
    """Rings, a ring with a chord, loops, chains and random edges, apart from each other."""
    rng = random.Random(7)
    parts = [
        [("a", "b"), ("b", "a")],
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("f", "g"), ("z", "a")],
        [(f"n{k:02}", f"n{k + 1:02}") for k in range(14)] + [("n14", "n03"), ("n11", "n08")],
        [(rng.choice("abcdefghijklmnop"), rng.choice("abcdefghijklmnop")) for _ in range(19)],
    ]
    return [(f"{k}{a}", f"{k}{b}") for k, part in enumerate(parts) for a, b in part]


def test_against_closure(spark):
    edges = graph()
    df = spark.createDataFrame([*edges, edges[0], (None, "0a"), ("0a", None)], "from_id string, to_id string")
    found = s.strong_components(df)
    reach = closure(edges)
    comp = {r.id: r.component for r in found.collect()}
    assert comp == {x: min([x, *(y for y in reach[x] if x in reach[y])]) for x in reach}
    inside = lambda c: [x for x in comp if comp[x] == c]
    cyclic = {c for c in comp.values() if c in reach[c]}
    cycles = {r.component: r.cycle for r in s.component_cycles(df, found).collect()}
    self_only = {c for c in comp.values() if any(x in reach[x] for x in inside(c))} - cyclic
    assert set(cycles) == cyclic and not self_only
    for c, way in cycles.items():
        assert way[0] == c and len(set(way)) == len(way) and all((a, b) in edges for a, b in zip(way, [*way[1:], c], strict=True))
        assert len(way) == shortest(edges, c)
    order = {r.id: r for r in s.condensed_order(df, found).collect()}
    for a, b in edges:
        assert comp[a] == comp[b] or order[a].level < order[b].level
    level = {}
    for c in sorted(set(comp.values()), key=lambda c: sum(comp[x] != c and c in reach[x] for x in comp)):
        level[c] = max([level[comp[a]] + 1 for a, b in edges if comp[b] == c and comp[a] != c], default=0)
    assert {x: level[comp[x]] for x in comp} == {x: r.level for x, r in order.items()}
    assert {x for x, r in order.items() if r.last} == {x for x in comp if any(comp[y] in cyclic and (x == y or x in reach[y]) for y in comp)}


def shortest(edges, c):
    level, far = {c}, 0
    while True:
        far += 1
        level = {b for a, b in edges if a in level}
        if c in level:
            return far


def test_no_edges(spark):
    df = spark.createDataFrame([], "from_id string, to_id string")
    found = s.strong_components(df)
    assert found.count() == s.component_cycles(df, found).count() == s.condensed_order(df, found).count() == 0


def betweenness(edges):
    """By definition: over all pairs, the share of shortest ways that lead through each node."""
    nodes = sorted({x for e in edges for x in e})
    edges = {(a, b) for a, b in edges if a != b}
    far, ways = {}, Counter()
    for start in nodes:
        far[start, start], ways[start, start], queue = 0, 1, deque([start])
        while queue:
            x = queue.popleft()
            for b in sorted(b for a, b in edges if a == x):
                if (start, b) not in far:
                    far[start, b] = far[start, x] + 1
                    queue.append(b)
                if far[start, b] == far[start, x] + 1:
                    ways[start, b] += ways[start, x]
    n = len(nodes)
    through = {x: sum(ways[a, x] * ways[x, b] / ways[a, b] for a, b in far if a != x != b and (a, x) in far and (x, b) in far and far[a, x] + far[x, b] == far[a, b]) for x in nodes}
    return {x: (sum(a == x for a, b in edges), sum(b == x for a, b in edges), sum(a == x != b for a, b in far), sum(b == x != a for a, b in far), through[x] / ((n - 1) * (n - 2))) for x in nodes}


def test_node_metrics(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(16), rng.randrange(16)) for _ in range(34)] + [(20, 21), (21, 20)]
    df = spark.createDataFrame([*edges, edges[3], (None, 1)], "from_id long, to_id long")
    want = betweenness(edges)
    for batches in (1, 3):
        got = {r.id: r for r in centrality.node_metrics(df, batches, at_once=batches + 1).collect()}
        assert set(got) == set(want)
        for x, (out, into, reach, dependents, share) in want.items():
            r = got[x]
            assert (r.out_degree, r.in_degree, r.reachable or 0, r.dependents or 0) == (out, into, reach, dependents) and abs(r.betweenness - share) < 1e-12
    assert centrality.node_metrics(df.limit(0)).count() == 0


def test_weak_components(spark):
    edges = graph()
    want = {x: x for e in edges for x in e}
    while any(want[a] != want[b] for a, b in edges):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    df = cut(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a string, b string"))
    got = {r.id: r.component for r in s.weak_components(df).collect()}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert all((got[x] == got[y]) == (want[x] == want[y]) for x in got for y in got)
    chain = cut(spark.createDataFrame([(k, k + 1) for k in range(300)] + [(400, k) for k in range(401, 700)], "a long, b long"))
    assert Counter(Counter(r.component for r in s.weak_components(chain).collect()).values()) == {301: 1, 300: 1}
    assert s.weak_components(cut(chain.limit(0))).count() == 0


def test_node_metrics_in_blocks_and_rounds(spark, monkeypatch):
    """A component in one task, one in blocks of sources that follow few edges at once, and one in rounds, with metrics of their own."""
    rng = random.Random(3)
    edges = [(f"s{rng.randrange(5)}", f"s{rng.randrange(5)}") for _ in range(6)]
    edges += [(f"m{rng.randrange(14)}", f"m{rng.randrange(14)}") for _ in range(26)] + [(f"r{k}", f"r{(k + 1) % 9}") for k in range(9)] + [(f"r{rng.randrange(9)}", f"r{rng.randrange(9)}") for _ in range(30)]
    monkeypatch.setattr(centrality, "SMALL", 8)
    monkeypatch.setattr(centrality, "WORK", 60)
    monkeypatch.setattr(centrality, "LARGE", 27)
    monkeypatch.setattr(centrality, "STEPS", 12)
    rounds, in_rounds = [], centrality._in_rounds
    monkeypatch.setattr(centrality, "_in_rounds", lambda e, *rest: (rounds.append({r.a[0] for r in e.collect()}), in_rounds(e, *rest))[1])
    want = betweenness(edges)
    got = {r.id: r for r in centrality.node_metrics(spark.createDataFrame(edges, "from_id string, to_id string")).collect()}
    assert rounds == [{"r"}]
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    loops = len(set(want) - set(got))
    scale = (len(want) - 1) * (len(want) - 2) / ((len(want) - loops - 1) * (len(want) - loops - 2))
    for x, r in got.items():
        assert (r.out_degree, r.in_degree, r.reachable, r.dependents) == want[x][:4] and abs(r.betweenness - want[x][4] * scale) < 1e-12


def test_node_metrics_writes_no_pairs(spark, monkeypatch):
    """A ring has as many pairs of a node and one that it reaches as the square of its nodes."""
    rows = []
    monkeypatch.setattr(centrality, "cut", lambda df: (out := cut(df), rows.append(out.count()))[0])
    ring = spark.createDataFrame([(k, (k + 1) % 24) for k in range(24)], "from_id long, to_id long")
    assert {(r.reachable, r.dependents, round(r.betweenness, 9)) for r in centrality.node_metrics(ring).collect()} == {(23, 23, 0.5)}
    assert sum(rows) <= 5 * 24
