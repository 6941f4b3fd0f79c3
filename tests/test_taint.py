"""Taint over calls: the small case of a route and a query function, and random programs against a plain version."""

from __future__ import annotations

import random

from tessera.operators import taint

SCHEMAS = {
    "modules": "fn string, module string", "parameters": "fn string, variable string", "sources": "fn string, variable string, line int", "moves": "fn string, source string, target string, clears array<string>",
    "arguments": "fn string, site int, callee string, parameter string, variable string", "results": "fn string, site int, callee string, variable string", "returns": "fn string, variable string", "sinks": "fn string, variable string, kind string, line int",
}


def frames(spark, rows):
    return {k: spark.createDataFrame(rows.get(k, []), schema) for k, schema in SCHEMAS.items()}


def test_route_to_query(spark):
    rows = {
        "modules": [("get_user", "routes"), ("execute_query", "db"), ("page", "routes")],
        "parameters": [("execute_query", "user_id")],
        "sources": [("get_user", "uid", 5), ("page", "q", 9)],
        "moves": [("execute_query", "user_id", "sql", None), ("page", "q", "safe", ["HTML"]), (None, "a", "b", None)],
        "arguments": [("get_user", 6, "execute_query", "user_id", "uid"), ("get_user", 7, "no_such", "x", "uid")],
        "sinks": [("execute_query", "sql", "SQL", 3), ("page", "safe", "HTML", 10), ("page", "q", "NETWORK", 11)],
    }
    program = frames(spark, rows)
    hits = taint.sink_hits(program, taint.transfers(program, ("SQL", "HTML", "NETWORK")))
    found = [tuple(r) for r in taint.vulnerabilities(program, hits).collect()]
    assert found == [("routes", "get_user", 5, "db", "execute_query", 3, "SQL", "HIGH", 89)]
    own = taint.vulnerabilities(program, hits, spark.createDataFrame([("routes",)], "module string")).filter("source_fn = 'page'").collect()
    assert [(r.sink_line, r.kind, r.severity, r.cwe) for r in own] == [(11, "NETWORK", "LOW", 918)]


def plain(p, kinds, rounds, depth):
    """Facts as sets of (fn, origin, variable, kind); an origin is a parameter's name or a source's function and line."""
    facts = {(f, v, v, k) for f, v in p["parameters"] for k in kinds} | {(f, (f, line), v, k) for f, v, line in p["sources"] for k in kinds}
    moves = {(f, a, b, k) for f, a, b, clears in p["moves"] for k in kinds if k not in (clears or [])}

    def close():
        while True:
            new = {(f, o, b, k) for f, o, v, k in facts for g, a, b, m in moves if (f, v, k) == (g, a, m)} - facts
            if not new:
                return
            facts.update(new)

    close()
    for _ in range(rounds):
        back = {(f, o, k) for f, o, v, k in facts if (f, v) in p["returns"]}
        moves |= {(f, v, r, k) for f, s, c, q, v in p["arguments"] for g, t, _, r in p["results"] if (f, s) == (g, t) for h, o, k in back if (h, o) == (c, q)}
        facts |= {(f, o, r, k) for f, _, c, r in p["results"] for h, o, k in back if h == c and isinstance(o, tuple)}
        close()
    hits = {(f, o, f, line, k) for f, o, v, k in facts for g, w, m, line in p["sinks"] if (f, v, k) == (g, w, m)}
    fresh = hits
    for _ in range(depth):
        fresh = {(f, o2, sf, line, k) for h, o, sf, line, k in fresh for f, _, c, q, v in p["arguments"] if (c, q) == (h, o) for g, o2, w, m in facts if (g, w, m) == (f, v, k)}
        hits = hits | fresh
    return facts, hits


def test_random_programs(spark):
    rng = random.Random(9)
    kinds = ("SQL", "HTML")
    fns = [f"{p}{k}" for p in range(4) for k in range(5)]
    near = lambda f: rng.choice([g for g in fns if g[0] == f[0]])
    var = lambda: rng.choice("abxyz")
    calls = [(f, s, near(f)) for f in fns for s in range(rng.randrange(3))]
    rows = {
        "modules": [(f, f"m{int(f[1]) % 3}") for f in fns],
        "parameters": [(f, v) for f in fns for v in "ab"],
        "sources": [(f, var(), 2) for f in fns if rng.random() < 0.3],
        "moves": [(f, var(), var(), rng.choice([None, [], ["SQL"], ["SQL", "HTML"]])) for f in fns for _ in range(3)],
        "arguments": [(f, s, c, v, var()) for f, s, c in calls for v in "ab"],
        "results": [(f, s, c, var()) for f, s, c in calls],
        "returns": [(f, var()) for f in fns if rng.random() < 0.7],
        "sinks": [(f, var(), rng.choice(kinds), 20) for f in fns if rng.random() < 0.5],
    }
    program = frames(spark, rows)
    facts = taint.transfers(program, kinds)
    origin = lambda r: r.parameter if r.parameter else (r.from_fn, r.from_line)
    want_facts, want_hits = plain(rows, kinds, 3, 2)
    assert {(r.fn, origin(r), r.variable, r.kind) for r in facts.collect()} == want_facts
    hits = taint.sink_hits(program, facts, depth=2)
    assert {(r.fn, origin(r), r.sink_fn, r.sink_line, r.kind) for r in hits.collect()} == want_hits
    module = dict(rows["modules"])
    want = {(o[0], o[1], sf, line, k) for _, o, sf, line, k in want_hits if isinstance(o, tuple) and module[o[0]] != module[sf]}
    assert {(r.source_fn, r.source_line, r.sink_fn, r.sink_line, r.kind) for r in taint.vulnerabilities(program, hits).collect()} == want


def test_calls_of_any_depth(spark):
    """What goes through a chain of eleven calls, each of which hands back what the next one returns, also reaches the first one."""
    last = 11
    fns = [f"f{k:02}" for k in range(last + 1)]
    calls = [(a, 1, b) for a, b in zip(fns, fns[1:], strict=False)] + [("f00", 2, "f05"), (fns[last], 9, fns[last])]
    rows = {
        "modules": [(f, "m") for f in fns],
        "parameters": [(f, "a") for f in fns],
        "sources": [(fns[last], "s", 7)],
        "moves": [(fns[last], "a", "r", None), (fns[last], "s", "r", ["HTML"]), ("f03", "z", "r", ["SQL"])] + [(f, "z", "r", None) for f in fns[:last] if f != "f03"],
        "arguments": [(f, s, c, "a", "a") for f, s, c in calls] + [("f00", 1, "f01", "no_such", "q")],
        "results": [(f, s, c, "z" if s == 1 else "other") for f, s, c in calls],
        "returns": [(f, "r") for f in fns] + [("f00", None)],
        "sinks": [("f00", "r", "HTML", 1), ("f00", "other", "SQL", 2)],
    }
    program = frames(spark, rows)
    facts = taint.transfers(program, ("SQL", "HTML"), rounds=None)
    want, _ = plain({**rows, "returns": [(f, "r") for f in fns]}, ("SQL", "HTML"), 30, 0)
    origin = lambda r: r.parameter if r.parameter else (r.from_fn, r.from_line)
    got = {(r.fn, origin(r), r.variable, r.kind) for r in facts.collect()}
    assert got == want and ("f00", "a", "r", "HTML") in got and ("f00", (fns[last], 7), "other", "SQL") in got


def test_queries_have_no_rounds(spark, tmp_path):
    """Parts that depend on each other in one chain: the source of the last one is known to all before it, as in the SQL."""
    import __spark_entry__ as entry
    import duckdb

    keys = [k for k in range(2, 200, 2) if k % 3 and k % 5 > 1 and k % 7][:14] + [154]
    spark.createDataFrame([(k, "one", 1) for k in keys], "p_partkey int, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, n, p, 1, 1.0, 0.0) for o, pair in enumerate(zip(keys, keys[1:], strict=False)) for n, p in enumerate(pair)]
    spark.createDataFrame(lines, "l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for t in ("part", "lineitem"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("return_transfers", "parameter_reach"):
        got, want = entry.queries()[name](spark, str(tmp_path)), duck.sql(entry.oracle_sql()[name])
        columns = sorted(want.columns)
        rows = sorted(tuple(r) for r in got.select(*columns).collect())
        assert rows == sorted(want.select(*columns).fetchall()) and rows
        if name == "return_transfers":
            assert {r["fn"]: r["sources"] for r in got.collect()} == dict.fromkeys(keys, 1)
