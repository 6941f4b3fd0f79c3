"""Resolution of imported names: what a name in a module stands for, in one pass and through any number of re-exports (P28, P29, T28,
T29).

symbols: module, name, public; imports: module, target, name ('*' for all), alias, line. Rows with a null module, target or name
take no part; of equal imports on one line, the one whose target is first by name counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut, discard


def module_of(path: Column) -> Column:
    """The dotted name of a file; a package is its __init__ file."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def absolute(imports: DataFrame) -> DataFrame:
    """imports (with level) with targets that no longer depend on the module: a dot for each part that is left off its name."""
    parts = F.split("module", r"\.")
    kept = F.slice(parts, 1, F.greatest(F.size(parts) - F.col("level"), F.lit(0)))
    inner = F.concat_ws(".", F.array_compact(F.concat(kept, F.array(F.nullif("target", F.lit(""))))))
    return imports.withColumn("target", F.when(F.col("level") > 0, inner).otherwise(F.col("target")))


def _rows(imports: DataFrame) -> DataFrame:
    columns = ["module", "target", "name", "line"]
    return imports.na.drop(subset=columns).select(*columns, F.coalesce("alias", "name").alias("bound")).distinct()


def resolve_symbols(uses: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """module, name, source_module, source_name, how: the definition of each used name (module, name). A definition of the module
    itself goes first, then imports of the name by line, each of a symbol or else of a module, then wildcards by line; how is local,
    import, module or wildcard, and null with the sources where nothing fits (P29)."""
    used = cut(uses.select("module", "name").na.drop().distinct())
    defined = cut(symbols.select(F.col("module").alias("in"), F.col("name").alias("symbol")).na.drop().distinct())
    modules = defined.select(F.col("in").alias("whole")).distinct()
    rows = cut(_rows(imports))
    rank = lambda step, sub: F.struct(F.lit(step).alias("step"), "line", "target", F.lit(sub).alias("sub"))
    found = lambda df, source, name, how, order: df.select("module", "name", order.alias("rank"), source.alias("source_module"), name.alias("source_name"), F.lit(how).alias("how"))
    none = F.struct(F.lit(1).alias("step"), F.lit(0).alias("line"), F.lit("").alias("target"), F.lit(0).alias("sub"))
    local = found(used.join(defined, (F.col("module") == F.col("in")) & (F.col("name") == F.col("symbol"))), F.col("in"), F.col("symbol"), "local", none)
    named = rows.filter("name <> '*'").withColumnsRenamed({"module": "at", "name": "imported"})
    named = used.join(named, (F.col("module") == F.col("at")) & (F.col("name") == F.col("bound")))
    direct = found(named.join(defined, (F.col("target") == F.col("in")) & (F.col("imported") == F.col("symbol"))), F.col("in"), F.col("symbol"), "import", rank(2, 1))
    full = F.when(F.col("target") == "", F.col("imported")).otherwise(F.concat_ws(".", "target", "imported"))
    nested = found(named.withColumn("full", full).join(modules, F.col("full") == F.col("whole")), F.col("full"), F.lit(None).cast("string"), "module", rank(2, 2))
    wild = rows.filter("name = '*'").withColumnRenamed("module", "at").drop("name")
    wild = used.join(wild, F.col("module") == F.col("at")).join(defined, (F.col("target") == F.col("in")) & (F.col("name") == F.col("symbol")))
    every = local.unionByName(direct).unionByName(nested).unionByName(found(wild, F.col("in"), F.col("symbol"), "wildcard", rank(3, 1)))
    best = every.groupBy("module", "name").agg(F.min(F.struct("rank", "source_module", "source_name", "how")).alias("best"))
    best = best.select(F.col("module").alias("m"), F.col("name").alias("n"), "best")
    return used.join(best, (F.col("module") == F.col("m")) & (F.col("name") == F.col("n")), "left").select("module", "name", "best.source_module", "best.source_name", "best.how")


def pointers(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """module, name, to_module, to_name: where each name that a module does not define comes from, by the first import that binds it,
    or that brings all public names of a module with it among them."""
    rows = _rows(imports)
    public = symbols.filter("public").select(F.col("module").alias("in"), F.col("name").alias("symbol")).na.drop().distinct()
    named = rows.filter("name <> '*'").select("module", F.col("bound").alias("name"), "line", F.col("target").alias("to_module"), F.col("name").alias("to_name"))
    wild = rows.filter("name = '*'").join(public, F.col("target") == F.col("in")).select("module", F.col("symbol").alias("name"), "line", F.col("target").alias("to_module"), F.col("symbol").alias("to_name"))
    first = named.unionByName(wild).groupBy("module", "name").agg(F.min(F.struct("line", "to_module", "to_name")).alias("first"))
    own = symbols.select(F.col("module").alias("m"), F.col("name").alias("n")).na.drop().distinct()
    unbound = first.join(own, (F.col("module") == F.col("m")) & (F.col("name") == F.col("n")), "left_anti")
    return unbound.select("module", "name", "first.to_module", "first.to_name")


def resolve_aliases(symbols: DataFrame, imports: DataFrame, longest: int | None = None) -> DataFrame:
    """module, name, to_module, to_name, hops, state: the end of each imported name's chain of re-exports (T28). state: resolved (a
    definition), missing (no import leads on), cycle (the chain never ends; no end and hops), and too_long for more than `longest`
    hops to a definition, if that is given.

    Each round replaces every pointer by its target's pointer, so that chains of n hops take log n rounds. What no longer moves in a
    round in which none came to an end runs in circles: chains of every greater length would have ended some."""
    state = cut(pointers(symbols, imports).withColumn("hops", F.lit(1).cast("long")))
    if state.isEmpty():
        return state.withColumn("state", F.lit(""))
    open_before = -1
    while True:
        t = state.select(F.col("module").alias("m"), F.col("name").alias("n"), F.col("to_module").alias("t_module"), F.col("to_name").alias("t_name"), F.col("hops").alias("t_hops"))
        on = (F.col("to_module") == F.col("m")) & (F.col("to_name") == F.col("n"))
        moved = state.join(t, on, "left").select(
            "module", "name", F.coalesce("t_module", "to_module").alias("to_module"), F.coalesce("t_name", "to_name").alias("to_name"),
            F.when(F.col("m").isNull(), F.col("hops")).otherwise(F.least(F.col("hops") + F.col("t_hops"), F.lit(1 << 61))).alias("hops"), F.col("m").isNotNull().alias("open"),
        )
        moved = cut(moved)
        still = moved.filter("open").count()
        if still in (0, open_before):
            break
        open_before = still
        discard(state)
        state = cut(moved.drop("open"))
        discard(moved)
    own = symbols.select(F.col("module").alias("m"), F.col("name").alias("n")).na.drop().distinct()
    ended = moved.join(own, (F.col("to_module") == F.col("m")) & (F.col("to_name") == F.col("n")), "left")
    deep = F.lit(False) if longest is None else F.col("hops") > longest
    kind = F.when(F.col("open"), "cycle").when(F.col("m").isNull(), "missing").when(deep, "too_long").otherwise("resolved")
    known = lambda c: F.when(~F.col("open"), F.col(c)).alias(c)
    return ended.select("module", "name", known("to_module"), known("to_name"), known("hops"), kind.alias("state"))
