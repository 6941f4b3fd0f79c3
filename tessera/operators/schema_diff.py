"""Changes between versions of JSON Schemas of any depth, with whether they break readers (D3).

Both versions are walked from the root, one level of nesting a round and all schemas at once, to a relation of nodes by path.
A path that both versions have is a node that both have with all that is above it; changes follow from those nodes alone, so
that nothing is reported below what was removed or added.

Texts that are no JSON object are left out with a null id or text; a key that a schema repeats makes it no JSON. Properties
that are no objects themselves (true, false) count as schemas without any demand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut, discard

#: What each change means to readers of the old version.
SEVERITY = {"field_removed": "breaking", "required_field_added": "breaking", "optional_field_added": "info", "field_made_required": "breaking", "field_type_changed": "breaking", "enum_value_removed": "breaking", "enum_value_added": "info"}


def _object(v: Column) -> Column:
    return F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("OBJECT"))


def schema_nodes(schemas: DataFrame) -> DataFrame:
    """id, path, type, properties, required and enum of every node of the schemas (id, schema: JSON text)."""
    strings = lambda path: F.coalesce(F.try_variant_get("v", path, "array<string>"), F.array().cast("array<string>"))
    under = F.variant_get("v", "$.properties", "variant")
    names = F.coalesce(F.json_object_keys(F.to_json(under)), F.array().cast("array<string>"))
    rows = schemas.filter("id IS NOT NULL").select("id", F.lit("#").alias("path"), F.try_parse_json("schema").alias("v")).filter(_object(F.col("v")))
    level, parts = cut(rows), []
    while not level.isEmpty():
        node = level.select("id", "path", F.try_variant_get("v", "$.type", "string").alias("type"), F.when(_object(under), names).otherwise(F.array().cast("array<string>")).alias("properties"), strings("$.required").alias("required"), strings("$.enum").alias("enum"))
        parts.append(cut(node))
        inner = level.select("id", "path", under.alias("p")).filter(_object(F.col("p")))
        each = inner.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("p").outer()))
        below = each.select("id", F.concat("path", F.lit("/properties/"), "key").alias("path"), F.col("value").alias("v"))
        items = level.select("id", F.concat("path", F.lit("/items")).alias("path"), F.variant_get("v", "$.items", "variant").alias("v")).filter(_object(F.col("v")))
        after = cut(below.unionByName(items))
        discard(level)
        level = after
    discard(level)
    empty = level.sparkSession.createDataFrame([], "id string, path string, type string, properties array<string>, required array<string>, enum array<string>")
    return reduce(DataFrame.unionByName, parts) if parts else empty.withColumn("id", F.col("id").cast(schemas.schema["id"].dataType))


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, path, change, severity, old_value and new_value between two versions of schemas (id, schema)."""
    columns = ("type", "properties", "required", "enum")
    a = schema_nodes(old).select("id", "path", *(F.col(c).alias(f"old_{c}") for c in columns))
    b = schema_nodes(new).select(F.col("id").alias("i"), F.col("path").alias("p"), *(F.col(c).alias(f"new_{c}") for c in columns))
    both = a.join(b, (F.col("id") == F.col("i")) & (F.col("path") == F.col("p")))
    none = F.lit(None).cast("string")
    row = lambda path, change, before, after: F.struct(path.alias("path"), change.alias("change"), before.alias("old_value"), after.alias("new_value"))
    of = lambda x: F.concat(F.col("path"), F.lit("/properties/"), x)
    missing = lambda x, y: F.array_except(x, y)
    added = F.transform(missing(F.col("new_properties"), F.col("old_properties")), lambda x: row(of(x), F.when(F.array_contains("new_required", x), "required_field_added").otherwise("optional_field_added"), none, none))
    removed = F.transform(missing(F.col("old_properties"), F.col("new_properties")), lambda x: row(of(x), F.lit("field_removed"), none, none))
    required = F.transform(F.array_intersect(missing(F.col("new_required"), F.col("old_required")), "old_properties"), lambda x: row(of(x), F.lit("field_made_required"), none, none))
    at = F.concat("path", F.lit("/enum"))
    gone = F.transform(missing(F.col("old_enum"), F.col("new_enum")), lambda x: row(at, F.lit("enum_value_removed"), x, none))
    came = F.transform(missing(F.col("new_enum"), F.col("old_enum")), lambda x: row(at, F.lit("enum_value_added"), none, x))
    kind = F.when(F.col("old_type") != F.col("new_type"), F.array(row(F.col("path"), F.lit("field_type_changed"), F.col("old_type"), F.col("new_type"))))
    every = F.concat(added, removed, required, gone, came, F.coalesce(kind, F.slice(F.array(row(F.col("path"), none, none, none)), 1, 0)))
    severity = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return both.select("id", F.inline(every)).withColumn("severity", severity[F.col("change")])
