"""Taint over the functions of a whole program: transfer relations of each function, composed over its calls.

A fact says that a variable of a function may hold what came from one of its parameters, or from a source anywhere, in a form
that is still dangerous to one kind of sink. Sanitisers stop the facts of the kinds that they clear, so that where several
assignments meet, only what all of them have cleared is clean.

A program is a dictionary of relations: modules (fn, module), parameters (fn, variable), sources (fn, variable, line), moves
(fn, source, target, clears: the kinds that the assignment sanitises), arguments (fn, site, callee, parameter, variable),
results (fn, site, callee, variable), returns (fn, variable) and sinks (fn, variable, kind, line). Functions that are called
but have no rows of their own return nothing and reach no sink; rows with null names take no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.fixpoint import spread
from tessera.operators.lineage import cut, together

Program = dict[str, DataFrame]
FACT = ["fn", "from_fn", "from_line", "parameter", "variable", "kind"]

#: CWE numbers and severities of the kinds of sinks; any other kind is LOW and has no number.
CWE = {"SQL": 89, "HTML": 79, "FILE": 22, "SHELL": 78, "EVAL": 94, "DESERIALIZATION": 502, "NETWORK": 918, "TEMPLATE": 1336}
SEVERITY = {"SQL": "HIGH", "SHELL": "HIGH", "EVAL": "HIGH", "DESERIALIZATION": "HIGH", "FILE": "MEDIUM", "TEMPLATE": "MEDIUM"}


def _renamed(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in columns))


def _closed(facts: DataFrame, moves: DataFrame) -> DataFrame:
    """Facts after all assignments of their functions, in any order."""
    m = _renamed(moves, "m_", "fn", "source", "target", "kind")
    same = (F.col("fn") == F.col("m_fn")) & (F.col("variable") == F.col("m_source")) & (F.col("kind") == F.col("m_kind"))
    return spread(facts.select(*FACT), lambda s: s.join(m, same).withColumn("variable", F.col("m_target")))


def _returning(program: Program, kinds: tuple[str, ...], moves: DataFrame, calls: DataFrame) -> DataFrame:
    """fn, variable, kind of what a function may return through calls of any depth: from what it returns back over its assignments,
    and from a call's result to each argument whose parameter the callee may return. No origins are kept."""
    m = _renamed(moves, "m_", "fn", "source", "target", "kind")
    into = (F.col("fn") == F.col("m_fn")) & (F.col("variable") == F.col("m_target")) & (F.col("kind") == F.col("m_kind"))
    c = _renamed(calls, "c_", *calls.columns)

    def passed(inner: DataFrame, outer: DataFrame) -> DataFrame:
        """The arguments whose parameter is in inner and whose call's result is in outer."""
        some = inner.join(c, (F.col("fn") == F.col("c_callee")) & (F.col("variable") == F.col("c_parameter"))).select("c_fn", "c_source", "c_target", "kind")
        o = _renamed(outer, "o_", "fn", "variable", "kind")
        both = some.join(o, (F.col("c_fn") == F.col("o_fn")) & (F.col("c_target") == F.col("o_variable")) & (F.col("kind") == F.col("o_kind")))
        return both.select(F.col("c_fn").alias("fn"), F.col("c_source").alias("variable"), "kind")

    seeds = program["returns"].na.drop().select("fn", "variable", F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"))
    back = lambda s: s.join(m, into).select("fn", F.col("m_source").alias("variable"), "kind")
    return spread(seeds, back, pairs=lambda new, every: passed(new, every).unionByName(passed(every, new)))


def _at_any_depth(program: Program, kinds: tuple[str, ...], facts: DataFrame, moves: DataFrame) -> DataFrame:
    """All facts after calls of any depth. What functions return of their parameters settles first, without origins, so that it has a
    row for each variable and kind at most; the facts then spread over one table of assignments, calls and returns."""
    results = _renamed(program["results"], "t_", "fn", "site", "callee", "variable")
    declared = _renamed(program["parameters"], "d_", "fn", "variable")
    calls = program["arguments"].join(declared, (F.col("callee") == F.col("d_fn")) & (F.col("parameter") == F.col("d_variable")), "left_semi")
    calls = calls.join(results, (F.col("fn") == F.col("t_fn")) & (F.col("site") == F.col("t_site")))
    calls = cut(calls.select("fn", F.col("variable").alias("source"), F.col("t_variable").alias("target"), "callee", "parameter").distinct())
    r = _renamed(_returning(program, kinds, moves, calls), "r_", "fn", "variable", "kind")
    through = calls.join(r, (F.col("callee") == F.col("r_fn")) & (F.col("parameter") == F.col("r_variable"))).select("fn", "source", "target", F.col("r_kind").alias("kind"))
    within = moves.unionByName(through).select("fn", F.col("source").alias("variable"), "kind", F.col("fn").alias("to_fn"), "target", F.lit(False).alias("up"))
    up = program["returns"].join(results, F.col("fn") == F.col("t_callee"))
    up = up.select("fn", "variable", F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"), F.col("t_fn").alias("to_fn"), F.col("t_variable").alias("target"), F.lit(True).alias("up"))
    ways = cut(within.unionByName(up).distinct())
    w = _renamed(ways, "w_", *ways.columns)
    along = (F.col("fn") == F.col("w_fn")) & (F.col("variable") == F.col("w_variable")) & (F.col("kind") == F.col("w_kind")) & (~F.col("w_up") | F.col("parameter").isNull())
    onward = lambda s: s.join(w, along).withColumns({"fn": F.col("w_to_fn"), "variable": F.col("w_target")})
    return spread(facts.select(*FACT), onward)


def transfers(program: Program, kinds: tuple[str, ...], rounds: int | None = 3) -> DataFrame:
    """All facts (FACT) when calls hand back what their callees return, over at most so many calls one behind the other, or over all
    where rounds is None: in each round the parameters that a callee returns become assignments of its callers, and the sources
    become facts of theirs."""
    every = F.explode(F.array(*(F.lit(k) for k in kinds)))
    of = {k: _renamed(program[k], f"{k}_", *program[k].columns) for k in ("returns", "results", "arguments")}
    null = lambda kind: F.lit(None).cast(kind)
    fn = program["modules"].schema["fn"].dataType
    own = program["parameters"].na.drop().select("fn", null(fn).alias("from_fn"), null("int").alias("from_line"), F.col("variable").alias("parameter"), "variable", every.alias("kind"))
    sources = program["sources"].na.drop().select("fn", F.col("fn").alias("from_fn"), F.col("line").cast("int").alias("from_line"), null("string").alias("parameter"), "variable", every.alias("kind"))
    moves = program["moves"].select("fn", "source", "target", "clears", every.alias("kind")).filter(~F.coalesce(F.array_contains("clears", F.col("kind")), F.lit(False)))
    moves = cut(moves.select("fn", "source", "target", "kind").distinct())
    if rounds is None:
        return _at_any_depth(program, kinds, own.unionByName(sources), moves)
    facts = _closed(own.unionByName(sources), moves)
    returned, known = None, -1
    for _ in range(rounds):
        returned = cut(facts.join(of["returns"], (F.col("fn") == F.col("returns_fn")) & (F.col("variable") == F.col("returns_variable"))).select("fn", "from_fn", "from_line", "parameter", "kind").distinct())
        if returned.count() == known:
            break
        known = returned.count()
        r = _renamed(returned, "r_", *returned.columns)
        site = (F.col("arguments_fn") == F.col("results_fn")) & (F.col("arguments_site") == F.col("results_site"))
        through = of["arguments"].join(r.filter("r_parameter IS NOT NULL"), (F.col("arguments_callee") == F.col("r_fn")) & (F.col("arguments_parameter") == F.col("r_parameter"))).join(of["results"], site)
        through = through.select(F.col("arguments_fn").alias("fn"), F.col("arguments_variable").alias("source"), F.col("results_variable").alias("target"), F.col("r_kind").alias("kind"))
        given = of["results"].join(r.filter("r_parameter IS NULL"), F.col("results_callee") == F.col("r_fn"))
        given = given.select(F.col("results_fn").alias("fn"), F.col("r_from_fn").alias("from_fn"), F.col("r_from_line").alias("from_line"), null("string").alias("parameter"), F.col("results_variable").alias("variable"), F.col("r_kind").alias("kind"))
        facts = _closed(facts.unionByName(given), cut(moves.unionByName(through).distinct()))
    return facts


def returned(program: Program, facts: DataFrame) -> DataFrame:
    """fn, from_fn, from_line, parameter, kind of what each function may return."""
    r = _renamed(program["returns"], "returns_", "fn", "variable")
    return facts.join(r, (F.col("fn") == F.col("returns_fn")) & (F.col("variable") == F.col("returns_variable"))).select("fn", "from_fn", "from_line", "parameter", "kind").distinct()


def sink_hits(program: Program, facts: DataFrame, depth: int = 5) -> DataFrame:
    """fn, from_fn, from_line, parameter, sink_fn, sink_line, kind: what reaches a sink from a function's parameter or from a source
    that it knows of, directly or through the parameters of up to `depth` calls."""
    columns = ["fn", "from_fn", "from_line", "parameter", "sink_fn", "sink_line", "kind"]
    s = _renamed(program["sinks"], "s_", "fn", "variable", "kind", "line")
    at = (F.col("fn") == F.col("s_fn")) & (F.col("variable") == F.col("s_variable")) & (F.col("kind") == F.col("s_kind"))
    direct = facts.join(s, at).select("fn", "from_fn", "from_line", "parameter", F.col("fn").alias("sink_fn"), F.col("s_line").alias("sink_line"), "kind")
    parts = [cut(direct.distinct())]
    call = _renamed(program["arguments"], "c_", "fn", "callee", "parameter", "variable")
    f = _renamed(facts, "f_", *FACT)
    for _ in range(depth):
        hits = parts[-1].filter("parameter IS NOT NULL").select("fn", "parameter", "sink_fn", "sink_line", "kind").distinct()
        calls = hits.join(call, (F.col("fn") == F.col("c_callee")) & (F.col("parameter") == F.col("c_parameter"))).select("c_fn", "c_variable", "sink_fn", "sink_line", "kind").distinct()
        up = calls.join(f, (F.col("c_fn") == F.col("f_fn")) & (F.col("c_variable") == F.col("f_variable")) & (F.col("kind") == F.col("f_kind")))
        up = up.select(F.col("c_fn").alias("fn"), F.col("f_from_fn").alias("from_fn"), F.col("f_from_line").alias("from_line"), F.col("f_parameter").alias("parameter"), "sink_fn", "sink_line", "kind").distinct()
        known = _renamed(together(parts), "k_", *columns)
        same = [F.col(c).eqNullSafe(F.col("k_" + c)) for c in columns]
        fresh = cut(up.select(*columns).join(known, same, "left_anti"))
        if fresh.isEmpty():
            break
        parts.append(fresh)
    return together(parts)


def _looked_up(kind: Column, values: dict, other: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[kind], other)


def vulnerabilities(program: Program, hits: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Flows from a source to a sink, once each, with severity and CWE: those over two modules, and within one module those of the
    modules in entries (module)."""
    m = program["modules"]
    flows = hits.filter("parameter IS NULL").select("from_fn", "from_line", "sink_fn", "sink_line", "kind").distinct()
    flows = flows.join(_renamed(m, "a_", "fn", "module"), F.col("from_fn") == F.col("a_fn")).join(_renamed(m, "b_", "fn", "module"), F.col("sink_fn") == F.col("b_fn"))
    wanted = F.col("a_module") != F.col("b_module")
    if entries is not None:
        flows = flows.join(entries.select(F.col("module").alias("entry")).distinct(), F.col("a_module") == F.col("entry"), "left")
        wanted = wanted | F.col("entry").isNotNull()
    kind = F.col("kind")
    return flows.filter(wanted).select(
        F.col("a_module").alias("source_module"), F.col("from_fn").alias("source_fn"), F.col("from_line").alias("source_line"), F.col("b_module").alias("sink_module"), "sink_fn", "sink_line",
        "kind", _looked_up(kind, SEVERITY, F.lit("LOW")).alias("severity"), _looked_up(kind, CWE, F.lit(None)).alias("cwe"),
    )
