"""Queries over the imports of a package of modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import parsing
from tessera.operators import imports as i
from tessera.operators.lineage import cut
from tessera.plans.registry import query
from tessera.sources import programs as p
from tessera.sources import views as v


@query(f"""WITH {p.PACKAGES}, uses AS (SELECT DISTINCT module, unnest(['api', 'helper']) AS name FROM imports UNION SELECT module, name FROM imports WHERE name <> '*'),
found AS (
  SELECT u.module, u.name, 1 AS step, 0 AS line, 1 AS sub, s.module AS source_module, s.name AS source_name, 'local' AS how FROM uses u JOIN symbols s USING (module, name)
  UNION ALL SELECT u.module, u.name, 2, line, 1, s.module, s.name, 'import' FROM uses u JOIN imports i ON i.module = u.module AND coalesce(i.alias, i.name) = u.name JOIN symbols s ON s.module = i.target AND s.name = i.name
  UNION ALL SELECT u.module, u.name, 2, line, 2, i.target || '.' || i.name, NULL, 'module' FROM uses u JOIN imports i ON i.module = u.module AND coalesce(i.alias, i.name) = u.name WHERE i.target || '.' || i.name IN (SELECT module FROM symbols)
  UNION ALL SELECT u.module, u.name, 3, line, 1, s.module, s.name, 'wildcard' FROM uses u JOIN imports i ON i.module = u.module AND i.name = '*' JOIN symbols s ON s.module = i.target AND s.name = u.name)
SELECT u.module, u.name, f.source_module, f.source_name, f.how FROM uses u LEFT JOIN (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY module, name ORDER BY step, line, sub) = 1) f USING (module, name)""")
def symbol_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """What each name that a module uses stands for: local, imported, a module or brought by a wildcard."""
    symbols, imports = (cut(x) for x in p.packages(spark, sf))
    uses = imports.select("module", F.explode(F.array(F.lit("api"), F.lit("helper"))).alias("name")).unionByName(imports.filter("name <> '*'").select("module", "name"))
    return i.resolve_symbols(uses, symbols, imports)


@query(f"""WITH RECURSIVE {p.PACKAGES}, bound AS (
  SELECT module, coalesce(alias, name) AS name, line, target AS to_module, name AS to_name FROM imports WHERE name <> '*'
  UNION ALL SELECT i.module, s.name, i.line, s.module, s.name FROM imports i JOIN symbols s ON s.module = i.target AND s.public WHERE i.name = '*'),
pointer AS (SELECT * FROM bound b WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.module = b.module AND s.name = b.name) QUALIFY row_number() OVER (PARTITION BY module, name ORDER BY line) = 1),
chain AS (SELECT module, name, to_module, to_name, 1 AS hops, [module || ' ' || name] AS seen FROM pointer UNION ALL
  SELECT c.module, c.name, q.to_module, q.to_name, c.hops + 1, list_append(c.seen, q.module || ' ' || q.name) FROM chain c JOIN pointer q ON q.module = c.to_module AND q.name = c.to_name WHERE NOT list_contains(c.seen, q.module || ' ' || q.name)),
ends AS (SELECT module, name, arg_max((to_module, to_name), hops) AS to, max(hops) AS hops FROM chain GROUP BY module, name),
told AS (SELECT e.module, e.name, e.to[1] AS to_module, e.to[2] AS to_name, e.hops, EXISTS (SELECT 1 FROM pointer q WHERE q.module = e.to[1] AND q.name = e.to[2]) AS cyclic,
  EXISTS (SELECT 1 FROM symbols s WHERE s.module = e.to[1] AND s.name = e.to[2]) AS defined FROM ends e)
SELECT module, name, CASE WHEN NOT cyclic THEN to_module END AS to_module, CASE WHEN NOT cyclic THEN to_name END AS to_name, CASE WHEN NOT cyclic THEN CAST(hops AS BIGINT) END AS hops,
  CASE WHEN cyclic THEN 'cycle' WHEN NOT defined THEN 'missing' WHEN hops > 4 THEN 'too_long' ELSE 'resolved' END AS state FROM told""")
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The definition behind each imported name through re-exports of any length, with circles marked."""
    symbols, imports = (cut(x) for x in p.packages(spark, sf))
    return i.resolve_aliases(symbols, imports, longest=4)


@query(f"""WITH {v.SRC}, i AS (SELECT path, regexp_extract(code, '^from ([a-z0-9_.]+) import', 1) AS target, regexp_extract(code, ' import ([a-z0-9_]+)', 1) AS name FROM src)
SELECT replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module, target, name, 'from' AS kind, 1 AS line FROM i""")
def python_imports(spark: SparkSession, sf: str) -> DataFrame:
    """The imports of all source files, from their syntax trees."""
    found = parsing.imports(v.src(spark, sf).select("path", F.col("code").alias("text"))).withColumn("module", i.module_of(F.col("path")))
    return i.absolute(found).select("module", "target", "name", "kind", "line")
