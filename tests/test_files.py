"""Sources, sinks and parsers on small files."""

from __future__ import annotations

import hashlib
import hmac
import json

from tessera.functions import parsing, signing
from tessera.sources import files, sinks


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\n\ndef f(x):\n    y = g(x)\n    return os.path.join(y, h(y))\n")
    (tmp_path / "src" / "run").write_text("#!/usr/bin/env python\n")
    (tmp_path / "build.log").write_text("x")
    assert files.listing(spark, str(tmp_path)).count() == 3
    t = files.texts(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in t.select("path", files.language(t.path, t.text).alias("kind")).collect()}
    assert kinds == {"a.py": "python", "run": "python", "build.log": "unknown"}
    kept = files.not_ignored(t, ["*.log", "run", "!run"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in kept.collect()) == ["a.py", "run"]
    assert {(r.caller, r.callee, r.line) for r in parsing.python_calls(t).collect()} == {("f", "g", 4), ("f", "os.path.join", 5), ("f", "h", 5)}
    assert {(r.name, r.def_line, r.use_line) for r in parsing.def_use_edges(t).collect()} == {("y", 4, 5)}


def test_owners_and_manifests(spark):
    paths = spark.createDataFrame([("docs/a.md",), ("src/x/b.py",), ("c.txt",)], "path string")
    assert [r.owner for r in files.owners(paths, [("*", "@all"), ("/docs/", "@docs"), ("*.py", "@py")]).collect()] == ["@docs", "@py", "@all"]
    req = spark.createDataFrame([("r", "# top\nFlask==2.0.1\nnumpy>=1.2 # c\nrequests[socks]~=2.3\nplain\n\n-r other")], "path string, text string")
    assert {(r.name, r.version) for r in files.requirements(req).collect()} == {("flask", "2.0.1"), ("numpy", "1.2"), ("requests", "2.3"), ("plain", None)}
    package = spark.createDataFrame([("p", json.dumps({"dependencies": {"a": "^1.0"}, "devDependencies": {"b": "~2.1", "a": ">=3"}})), ("q", "{}")], "path string, text string")
    assert {(r.name, r.version) for r in files.package_json(package).collect()} == {("a", "3"), ("b", "2.1")}


def test_reports_and_logs(spark, tmp_path):
    doc = {"runs": [{"tool": {"driver": {"name": "lint"}}, "results": [{"ruleId": "E1", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3}}}]}, {"ruleId": "E2", "level": "error"}]}]}
    got = files.sarif(spark.createDataFrame([(json.dumps(doc),)], "text string")).collect()
    assert {tuple(r) for r in got} == {("lint", "E1", "warning", "a.py", 3), ("lint", "E2", "error", None, None)}
    (tmp_path / "log.jsonl").write_text('{"ts": "2024-01-01T00:00:00", "kind": "a"}\nnot json\n{"ts": "2024-01-02T00:00:00", "kind": "b"}\n')
    log = files.audit_log(spark, str(tmp_path / "log.jsonl"), "ts timestamp, kind string")
    assert sorted(r.kind for r in log.collect()) == ["a", "b"]
    sinks.append_audit(log, str(tmp_path / "audit"))
    sinks.append_audit(log, str(tmp_path / "audit"))
    assert sinks.keep_days(spark, str(tmp_path / "audit"), "2024-01-02").count() == 2
    parts = files.virtual_files(spark.createDataFrame([("// FILE: a.js\nlet x\n// FILE: b.py\nx = 1\n",)], "text string"))
    assert {tuple(r) for r in parts.collect()} == {("a.js", "let x\n"), ("b.py", "x = 1\n")}
    edges = spark.createDataFrame([("a:1", "b"), ("a:1", "b")], "from_id string, to_id string")
    assert [r.line for r in sinks.mermaid_lines(edges).collect()] == ["graph TD", '  a_1["a:1"] --> b["b"]']
    sinks.graph_json(edges, edges, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "edges")).count() == 2


def test_signatures(spark):
    good = hmac.new(b"k", b"p", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("p", good), ("p", "no"), (None, None)], "payload string, signature string")
    assert [r.valid for r in signing.verified(df, b"k").collect()] == [True, False, False]
    long = b"k" * 100
    df = spark.createDataFrame([("é", hmac.new(long, "é".encode(), hashlib.sha256).hexdigest())], "payload string, signature string")
    assert signing.verified(df, long).first().valid
