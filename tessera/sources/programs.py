"""Programs that the driver tables stand for: flow graphs of procedures, and functions that call each other over several modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.views import M_EDGES, m_edges, table


def flow_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """proc, node (from 1), last, part and supp: an order is a procedure and its lines are statements."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    whole = Window.partitionBy("l_orderkey")
    line = table(spark, sf, "lineitem").withColumn("node", F.row_number().over(order)).withColumn("last", F.count(F.lit(1)).over(whole))
    return line.select(F.col("l_orderkey").alias("proc"), F.col("node").cast("long").alias("node"), "last", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))


def flow_edges(nodes: DataFrame) -> DataFrame:
    """proc, a, b: to the next statement, past it where a part divides by three, and back where it divides by five."""
    onward = nodes.filter("node < last").select("proc", F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    past = nodes.filter("part % 3 = 0 AND node + 2 <= last").select("proc", F.col("node").alias("a"), (F.col("node") + 2).alias("b"))
    back = nodes.filter("part % 5 = 0").select("proc", F.col("node").alias("a"), (1 + F.col("supp") % F.col("node")).alias("b"))
    return onward.unionByName(past).unionByName(back)


FLOW = """nodes AS (
  SELECT l_orderkey AS proc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS node, count(*) OVER (PARTITION BY l_orderkey) AS last,
    l_partkey AS part, l_suppkey AS supp FROM lineitem),
edges AS (
  SELECT proc, node AS a, node + 1 AS b FROM nodes WHERE node < last UNION SELECT proc, node, node + 2 FROM nodes WHERE part % 3 = 0 AND node + 2 <= last
  UNION SELECT proc, node, 1 + supp % node FROM nodes WHERE part % 5 = 0),
defs AS (SELECT proc, node, 'v' || (supp % 4) AS variable FROM nodes), uses AS (SELECT proc, node, 'v' || (part % 4) AS variable FROM nodes)"""


def definitions(nodes: DataFrame) -> DataFrame:
    """proc, node, variable that a statement writes."""
    return nodes.select("proc", "node", F.concat(F.lit("v"), (F.col("supp") % 4).cast("string")).alias("variable"))


def uses(nodes: DataFrame) -> DataFrame:
    """proc, node, variable that a statement reads."""
    return nodes.select("proc", "node", F.concat(F.lit("v"), (F.col("part") % 4).cast("string")).alias("variable"))


def functions(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """A function of two parameters, a and b, for each part, in the module of its size; it calls the parts that it depends on:

    x = a, or a request's argument (keys that divide by 7)
    y = x, its HTML escape (key % 5 = 0) or its integer (key % 5 = 1)
    z1 = f1(y, b), z2 = f2(y, b) and so on
    w = any of the z, y (even keys) or b (key % 10 = 3)
    a query with w (key % 11 = 0), a page with w (key % 13 = 0), a command with b (key % 17 = 0)
    return w (unless the key divides by 3)"""
    f = table(spark, sf, "part").select(F.col("p_partkey").alias("fn"), (F.col("p_size") % 10).alias("module"))
    calls = m_edges(spark, sf).select(F.col("from_id").alias("fn"), F.col("to_id").alias("callee"))
    z = F.concat(F.lit("z"), F.col("callee").cast("string"))
    none, escape, whole = (F.array(*(F.lit(k) for k in ks)).cast("array<string>") for ks in ((), ("HTML",), ("SQL", "HTML", "SHELL")))
    key = F.col("fn")
    var = lambda df, a, b, clears=none: df.select("fn", F.lit(a).alias("source") if isinstance(a, str) else a.alias("source"), F.lit(b).alias("target") if isinstance(b, str) else b.alias("target"), clears.alias("clears"))
    moves = [var(f.filter(key % 7 != 0), "a", "x"), var(f, "x", "y", F.when(key % 5 == 0, escape).when(key % 5 == 1, whole).otherwise(none)), var(calls, z, "w"), var(f.filter(key % 2 == 0), "y", "w"), var(f.filter(key % 10 == 3), "b", "w")]
    sink = lambda n, name, kind, line: f.filter(key % n == 0).select("fn", F.lit(name).alias("variable"), F.lit(kind).alias("kind"), F.lit(line).alias("line"))
    return {
        "modules": f,
        "parameters": f.select("fn", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("variable")),
        "sources": f.filter(key % 7 == 0).select("fn", F.lit("x").alias("variable"), F.lit(2).alias("line")),
        "moves": reduce(DataFrame.unionByName, moves),
        "arguments": calls.select("fn", F.col("callee").alias("site"), "callee", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("y"), F.lit("b")))).alias("parameter", "variable")),
        "results": calls.select("fn", F.col("callee").alias("site"), "callee", z.alias("variable")),
        "returns": f.filter(key % 3 != 0).select("fn", F.lit("w").alias("variable")),
        "sinks": sink(11, "w", "SQL", 20).unionByName(sink(13, "w", "HTML", 21)).unionByName(sink(17, "b", "SHELL", 22)),
    }


#: The same program, with facts of its variables y and w (from_fn: the function of the source, parameter: that of fn) round by round.
_ROUND = """w{k} AS (
  SELECT * FROM w0 UNION
  SELECT c.fn, y.from_fn, y.parameter, y.kind FROM calls c JOIN w{j} r ON r.fn = c.callee AND r.fn % 3 <> 0 AND r.parameter = 'a' JOIN y ON y.fn = c.fn AND y.kind = r.kind UNION
  SELECT c.fn, NULL, 'b', r.kind FROM calls c JOIN w{j} r ON r.fn = c.callee AND r.fn % 3 <> 0 AND r.parameter = 'b' UNION
  SELECT c.fn, r.from_fn, NULL, r.kind FROM calls c JOIN w{j} r ON r.fn = c.callee AND r.fn % 3 <> 0 AND r.parameter IS NULL)"""
_PROGRAM = f"""{M_EDGES}, f AS (SELECT p_partkey AS fn, p_size % 10 AS module FROM part), calls AS (SELECT from_id AS fn, to_id AS callee FROM m_edges),
kinds(kind) AS (VALUES ('SQL'), ('HTML'), ('SHELL')),
y AS (SELECT fn, CASE WHEN fn % 7 = 0 THEN fn END AS from_fn, CASE WHEN fn % 7 <> 0 THEN 'a' END AS parameter, kind FROM f, kinds WHERE fn % 5 <> 1 AND (fn % 5 <> 0 OR kind <> 'HTML')),
w0 AS (SELECT * FROM y WHERE fn % 2 = 0 UNION SELECT fn, NULL, 'b', kind FROM f, kinds WHERE fn % 10 = 3),
"""
_HITS = """hits(fn, from_fn, parameter, sink_fn, sink_line, kind, depth) AS (
  (SELECT fn, from_fn, parameter, fn, CASE kind WHEN 'SQL' THEN 20 ELSE 21 END, kind, 0 FROM {w} WHERE kind = 'SQL' AND fn % 11 = 0 OR kind = 'HTML' AND fn % 13 = 0
   UNION SELECT fn, NULL, 'b', fn, 22, 'SHELL', 0 FROM f WHERE fn % 17 = 0)
  UNION SELECT c.fn, y.from_fn, y.parameter, h.sink_fn, h.sink_line, h.kind, h.depth + 1 FROM (SELECT DISTINCT fn, sink_fn, sink_line, kind, depth, parameter FROM hits WHERE depth < 5) h
    JOIN calls c ON c.callee = h.fn JOIN (SELECT *, 'a' AS through FROM y UNION ALL SELECT fn, NULL, 'b', kind, 'b' FROM f, kinds) y ON y.fn = c.fn AND y.kind = h.kind AND y.through = h.parameter)"""
FUNCTIONS = f"""{_PROGRAM}{", ".join(_ROUND.format(k=k, j=k - 1) for k in (1, 2, 3))},
{_HITS.format(w="w3")}"""
#: The same with facts w of calls of any depth.
FUNCTIONS_ANY_DEPTH = f"""{_PROGRAM}w(fn, from_fn, parameter, kind) AS (
  SELECT * FROM w0 UNION
  SELECT c.fn, CASE r.parameter WHEN 'a' THEN y.from_fn WHEN 'b' THEN NULL ELSE r.from_fn END, CASE r.parameter WHEN 'a' THEN y.parameter ELSE r.parameter END, r.kind
  FROM w r JOIN calls c ON r.fn = c.callee AND r.fn % 3 <> 0 LEFT JOIN y ON y.fn = c.fn AND y.kind = r.kind WHERE r.parameter IS DISTINCT FROM 'a' OR y.fn IS NOT NULL),
{_HITS.format(w="w")}"""


def code_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """id (file and function), key, module, type and complexity of each part's function."""
    key = F.col("p_partkey")
    folder = F.when(key % 10 == 9, "tests/").otherwise(F.concat(F.lit("pkg_"), (key % 10).cast("string"), F.lit("/")))
    name = F.concat(F.when(key % 6 == 0, "_").otherwise(""), F.lit("f"), key.cast("string"))
    module = F.when(F.col("p_size") % 10 == 0, "external").otherwise(F.col("p_brand"))
    kind = F.element_at(F.array(F.lit("function"), F.lit("method"), F.lit("class")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select(F.concat(folder, F.lit("m"), key.cast("string"), F.lit(".py::"), name).alias("id"), key.alias("key"), "p_brand", module.alias("module"), kind.alias("type"), F.col("p_size").alias("complexity"))


def code_edges(spark: SparkSession, sf: str) -> DataFrame:
    """from_id, to_id, type, confidence, weight and the complexity of what is called."""
    n = code_nodes(spark, sf)
    a, b = n.select(F.col("key").alias("a"), F.col("id").alias("a_id")), n.select(F.col("key").alias("b"), F.col("id").alias("b_id"), "complexity")
    e = m_edges(spark, sf).join(a.hint("merge"), F.col("from_id") == F.col("a")).join(b.hint("merge"), F.col("to_id") == F.col("b"))
    return e.select(F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id"), "type", "confidence", (1.0 / F.col("n")).alias("weight"), "complexity")


CODE = f"""{M_EDGES}, code_nodes AS (
  SELECT CASE WHEN p_partkey % 10 = 9 THEN 'tests/' ELSE 'pkg_' || (p_partkey % 10) || '/' END || 'm' || p_partkey || '.py::' || CASE WHEN p_partkey % 6 = 0 THEN '_' ELSE '' END || 'f' || p_partkey AS id,
    p_partkey AS key, p_brand, CASE WHEN p_size % 10 = 0 THEN 'external' ELSE p_brand END AS module, CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS type, p_size AS complexity FROM part),
code_edges AS (
  SELECT a.id AS from_id, b.id AS to_id, e.type, confidence, 1.0::DOUBLE / n AS weight, b.complexity, a.module AS from_module, a.type AS from_type, b.module AS to_module, b.type AS to_type
  FROM m_edges e JOIN code_nodes a ON a.key = e.from_id JOIN code_nodes b ON b.key = e.to_id)"""


def packages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and imports of a module for each part: `api` is defined where the key divides by 6 and is imported from the modules that
    it depends on otherwise, on a line each, from the second one on as `helper`; where the key divides by 7, with all else that
    is public; where it divides by 9, as a module of the package."""
    key = F.col("p_partkey")
    module = lambda c: F.concat(F.lit("pkg.m"), F.col(c).cast("string"))
    part = table(spark, sf, "part")
    own = part.select(module("p_partkey").alias("module"), F.concat(F.lit("_own"), key.cast("string")).alias("name"), F.lit(False).alias("public"))
    symbols = own.unionByName(part.filter(key % 6 == 0).select(module("p_partkey").alias("module"), F.lit("api").alias("name"), F.lit(True).alias("public")))
    line = F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("n"), "to_id"))
    e = m_edges(spark, sf).withColumn("line", line)
    wild, nested = F.col("from_id") % 7 == 0, F.col("from_id") % 9 == 0
    name = F.when(wild, "*").when(nested, F.concat(F.lit("m"), F.col("to_id").cast("string"))).otherwise("api")
    alias = F.when(~wild & (F.col("line") > 1), "helper")
    return symbols, e.select(module("from_id").alias("module"), F.when(~wild & nested, "pkg").otherwise(module("to_id")).alias("target"), name.alias("name"), alias.alias("alias"), "line")


PACKAGES = f"""{M_EDGES}, symbols AS (SELECT 'pkg.m' || p_partkey AS module, '_own' || p_partkey AS name, false AS public FROM part UNION ALL SELECT 'pkg.m' || p_partkey, 'api', true FROM part WHERE p_partkey % 6 = 0),
imports AS (SELECT 'pkg.m' || from_id AS module, CASE WHEN from_id % 7 <> 0 AND from_id % 9 = 0 THEN 'pkg' ELSE 'pkg.m' || to_id END AS target,
  CASE WHEN from_id % 7 = 0 THEN '*' WHEN from_id % 9 = 0 THEN 'm' || to_id ELSE 'api' END AS name, CASE WHEN from_id % 7 <> 0 AND line > 1 THEN 'helper' END AS alias, line
  FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) AS line FROM m_edges))"""
