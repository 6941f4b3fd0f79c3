"""Recursive schema changes against a plain walk over random nested schemas."""

from __future__ import annotations

import json
import random

from tessera.operators import schema_diff as d


def walk(old, new, path, out):
    if "type" in old and "type" in new and old["type"] != new["type"]:
        out.append((path, "field_type_changed"))
    a, b = old.get("properties", {}), new.get("properties", {})
    out += [(f"{path}/properties/{x}", "field_removed") for x in set(a) - set(b)]
    out += [(f"{path}/properties/{x}", "required_field_added" if x in new.get("required", []) else "optional_field_added") for x in set(b) - set(a)]
    out += [(f"{path}/properties/{x}", "field_made_required") for x in set(new.get("required", [])) - set(old.get("required", [])) if x in a]
    e, f = ({str(x) for x in s.get("enum", [])} for s in (old, new))
    out += [(f"{path}/enum", "enum_value_removed")] * len(e - f) + [(f"{path}/enum", "enum_value_added")] * len(f - e)
    for x in set(a) & set(b):
        walk(a[x] if isinstance(a[x], dict) else {}, b[x] if isinstance(b[x], dict) else {}, f"{path}/properties/{x}", out)
    if isinstance(old.get("items"), dict) and isinstance(new.get("items"), dict):
        walk(old["items"], new["items"], f"{path}/items", out)
    return out


def schema(rng, depth):
    if rng.random() < 0.1:
        return True
    out = {}
    if rng.random() < 0.8:
        out["type"] = rng.choice(["object", "string", "integer"])
    if depth and rng.random() < 0.9:
        out["properties"] = {x: schema(rng, depth - 1) for x in rng.sample(["a", "b", "c", "é", "a/b"], rng.randrange(4))}
        out["required"] = rng.sample(["a", "b", "c", "q"], rng.randrange(3))
    if depth and rng.random() < 0.4:
        out["items"] = schema(rng, depth - 1)
    if rng.random() < 0.3:
        out["enum"] = rng.sample(["x", "y", 3, "z"], 2)
    return out


def test_against_plain_walk(spark):
    rng = random.Random(6)
    old, new = ([schema(rng, 4) for _ in range(40)] for _ in range(2))
    deep = {"type": "integer"}
    for _ in range(6):
        deep = {"properties": {"x": deep}}
    old, new = [*old, deep], [*new, json.loads(json.dumps(deep).replace("integer", "string"))]
    rows = lambda xs: [*((k, json.dumps(x)) for k, x in enumerate(xs)), (900, "{bad"), (901, None), (None, "{}"), (902, "[1]")]
    a, b = (spark.createDataFrame(rows(xs), "id long, schema string") for xs in (old, new))
    rows_found = d.schema_changes(a, b).collect()
    got = sorted((r.id, r.path, r.change) for r in rows_found)
    want = sorted((k, *c) for k, (x, y) in enumerate(zip(old, new, strict=True)) if isinstance(x, dict) and isinstance(y, dict) for c in walk(x, y, "#", []))
    assert got == want and (40, "#" + "/properties/x" * 6, "field_type_changed") in got and len({c for _, _, c in got}) == 7
    kinds = {r.change: r.severity for r in rows_found}
    assert kinds == {k: d.SEVERITY[k] for k in kinds}
    assert d.schema_changes(a.filter("id < 0"), b).count() == 0
