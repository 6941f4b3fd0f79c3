"""Queries over versions of nested schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import schema_diff
from tessera.plans.registry import query
from tessera.sources import views as v


def schemas(spark: SparkSession, sf: str, without: int) -> DataFrame:
    """A JSON Schema for each brand: an object for each type of part, in it a field for each name of a part. `without` is the
    remainder by 3 of the keys that the version does not know of."""
    part = v.table(spark, sf, "part").filter(F.col("p_partkey") % 3 != without)
    n = F.col("n")
    kind = F.when(n % 3 == 0, "integer").when(n % 3 == 1, "string").otherwise("array")
    values = F.when(n % 3 == 1, F.array_distinct(F.array(F.concat(F.lit("e"), (n % 4).cast("string")), F.concat(F.lit("e"), (n % 5).cast("string")))))
    items = F.when(n % 3 == 2, F.struct(F.when(n % 2 == 0, "integer").otherwise("string").alias("type")))
    entry = lambda name, body: F.map_from_entries(F.collect_list(F.struct(name, body)))
    listed = lambda name, when: F.array_sort(F.collect_list(F.when(when, F.col(name))))
    fields = part.groupBy("p_brand", "p_type", "p_name").agg(F.min("p_size").alias("n")).withColumn("field", F.struct(kind.alias("type"), values.alias("enum"), items.alias("items")))
    types = fields.groupBy("p_brand", "p_type").agg(entry("p_name", "field").alias("properties"), listed("p_name", n % 4 == 0).alias("required"), F.count(F.lit(1)).alias("k"))
    types = types.withColumn("body", F.struct(F.lit("object").alias("type"), "properties", "required"))
    root = types.groupBy(F.col("p_brand").alias("id")).agg(entry("p_type", "body").alias("properties"), listed("p_type", F.col("k") % 2 == 0).alias("required"))
    return root.select("id", F.to_json(F.struct(F.lit("object").alias("type"), "properties", "required")).alias("schema"))


#: Fields, types and root of both versions; each change follows from joins at its own level.
_VERSIONS = """a AS (SELECT p_brand AS id, p_type AS t, p_name AS f, min(p_size) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL), b AS (SELECT p_brand AS id, p_type AS t, p_name AS f, min(p_size) AS n FROM part WHERE p_partkey % 3 <> 1 GROUP BY ALL),
ta AS (SELECT id, t, count(*) % 2 = 0 AS req FROM a GROUP BY id, t), tb AS (SELECT id, t, count(*) % 2 = 0 AS req FROM b GROUP BY id, t), ids AS (SELECT DISTINCT a.id FROM a JOIN b USING (id)), ts AS (SELECT ta.id, ta.t FROM ta JOIN tb USING (id, t)),
fields AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.t, b.t) AS t, coalesce(a.f, b.f) AS f, a.n AS old, b.n AS new FROM a FULL JOIN b ON a.id = b.id AND a.t = b.t AND a.f = b.f),
leaf AS (SELECT '#/properties/' || t || '/properties/' || f AS path, * FROM fields JOIN ts USING (id, t)),
ea AS (SELECT DISTINCT id, path, unnest(['e' || (old % 4), 'e' || (old % 5)]) AS e FROM leaf WHERE old % 3 = 1 AND new IS NOT NULL), eb AS (SELECT DISTINCT id, path, unnest(['e' || (new % 4), 'e' || (new % 5)]) AS e FROM leaf WHERE new % 3 = 1 AND old IS NOT NULL),
kinds AS (SELECT *, CASE old % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'string' ELSE 'array' END AS ok, CASE new % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'string' ELSE 'array' END AS nk, CASE WHEN old % 2 = 0 THEN 'integer' ELSE 'string' END AS oi, CASE WHEN new % 2 = 0 THEN 'integer' ELSE 'string' END AS ni FROM leaf WHERE old IS NOT NULL AND new IS NOT NULL)"""


@query(f"""WITH {_VERSIONS}, changes AS (
  SELECT coalesce(ta.id, tb.id) AS id, '#/properties/' || coalesce(ta.t, tb.t) AS path, CASE WHEN tb.t IS NULL THEN 'field_removed' WHEN tb.req THEN CASE WHEN ta.t IS NULL THEN 'required_field_added' ELSE 'field_made_required' END ELSE 'optional_field_added' END AS change, NULL AS old_value, NULL AS new_value
    FROM ta FULL JOIN tb ON ta.id = tb.id AND ta.t = tb.t WHERE (ta.t IS NULL OR tb.t IS NULL OR tb.req AND NOT ta.req) AND coalesce(ta.id, tb.id) IN (SELECT id FROM ids)
  UNION ALL SELECT id, path, CASE WHEN new IS NULL THEN 'field_removed' WHEN old IS NOT NULL THEN 'field_made_required' WHEN new % 4 = 0 THEN 'required_field_added' ELSE 'optional_field_added' END, NULL, NULL FROM leaf WHERE old IS NULL OR new IS NULL OR new % 4 = 0 AND old % 4 <> 0
  UNION ALL SELECT id, path, 'field_type_changed', ok, nk FROM kinds WHERE ok <> nk
  UNION ALL SELECT id, path || '/items', 'field_type_changed', oi, ni FROM kinds WHERE ok = 'array' AND nk = 'array' AND oi <> ni
  UNION ALL SELECT id, path || '/enum', 'enum_value_removed', e, NULL FROM ea ANTI JOIN eb USING (id, path, e) UNION ALL SELECT id, path || '/enum', 'enum_value_added', NULL, e FROM eb ANTI JOIN ea USING (id, path, e))
SELECT *, CASE WHEN change IN ('optional_field_added', 'enum_value_added') THEN 'info' ELSE 'breaking' END AS severity FROM changes""")
def nested_schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between two versions of a nested schema for each brand."""
    return schema_diff.schema_changes(schemas(spark, sf, 0), schemas(spark, sf, 1))
