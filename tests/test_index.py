"""Index updates in place, and the SQLite audit source with pushed filters."""

from __future__ import annotations

import contextlib
import glob
import io
import os
import sqlite3

from pyspark.sql import functions as F

from tessera.sources import audit_db
from tessera.sources.index import Index


def stamps(path):
    return {f: (os.stat(f).st_ino, os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_index_updates(spark, tmp_path):
    path, schema = f"{tmp_path}/index", "path string, digest string, lines long"
    index = Index(spark, f"file://{path}", schema, buckets=16)
    files = [(f"f{k}", f"d{k}", k) for k in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    index.create(frame([*files, files[0], (None, "x", 1)]))
    before = stamps(path)
    assert index.changes(frame(files)).count() == 0 and index.upsert(frame(files)).count() == 0 and stamps(path) == before
    now = [("f1", "new", 5), *(f for f in files if f[0] not in ("f1", "f2", "f3")), ("g", "d", 1), ("f3", None, 9)]
    found = {r.path: r.state for r in index.upsert(frame(now)).collect()}
    assert found == {"f1": "changed", "f2": "removed", "f3": "changed", "g": "new"}
    assert sorted((r.path, r.digest, r.lines) for r in index.read().collect()) == sorted(now, key=lambda x: x[0])
    touched = {r[0] for r in frame([(p, "", 0) for p in found]).select(F.pmod(F.xxhash64("path"), F.lit(16)).alias("b")).collect()}
    same = {f: s for f, s in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    after = stamps(path)
    assert same and all(after[f] == s for f, s in same.items()) and set(after) & set(before) == set(same)
    stats = index.stale(frame([x for x in now if x[0] != "g"])).first()
    assert (stats.files, stats.stale) == (60, 1) and abs(stats.hit_rate - 59 / 60) < 1e-12
    depends = spark.createDataFrame([("f5", "f4"), ("f6", "f5"), ("f4", "f6"), ("f9", "f8")], "from_id string, to_id string")
    gone = {r.path for r in index.invalidate(frame([("f5", "", 0)]), depends).collect()}
    assert gone == {"f4", "f5", "f6"} and index.read().count() == 57
    index.upsert(frame([]))
    assert index.read().count() == 0 and index.upsert(frame(files)).count() == 60 and index.read().count() == 60


def audit_file(path, rows, columns="event_id TEXT, request_id TEXT, tool_name TEXT, status TEXT, timestamp REAL, duration_ms REAL"):
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE {audit_db.TABLE} ({columns})")
        for row in rows:
            db.execute(f"INSERT INTO {audit_db.TABLE} VALUES ({', '.join('?' * len(row))})", row)
    db.close()


def test_audit_source(spark, tmp_path):
    rows = [(f"e{k}", f"r{k % 7}", ("crawl", "scan", "Scan_x%")[k % 3], None if k % 11 == 0 else ("success", "failure")[k % 2], float(k), k / 2) for k in range(1000)]
    audit_file(f"{tmp_path}/a.db", rows[:600])
    audit_file(f"{tmp_path}/b.db", rows[600:])
    audit_file(f"{tmp_path}/c.db", [("old", "scan")], "event_id TEXT, tool_name TEXT")
    audit_file(f"{tmp_path}/d.db", [])
    sqlite3.connect(f"{tmp_path}/e.db").close()
    spark.dataSource.register(audit_db.AuditSource)
    read = lambda: spark.read.format("audit_sqlite").option("path", str(tmp_path)).option("rows", "100").load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        log = read()
        assert log.count() == 1001 and log.rdd.getNumPartitions() == 11
        assert log.filter("session_id IS NULL AND status IS NULL").count() == 92
        cases = {
            "status = 'failure' AND timestamp >= 500": [r for r in rows if r[3] == "failure" and r[4] >= 500],
            "request_id IN ('r1', 'r2') AND timestamp < 100": [r for r in rows if r[1] in ("r1", "r2") and r[4] < 100],
            "tool_name LIKE 'Scan%' AND event_id LIKE '%9'": [r for r in rows if r[2].startswith("Scan") and r[0].endswith("9")],
            "contains(tool_name, 'x%') AND duration_ms > 100.25": [r for r in rows if "x%" in r[2] and r[5] > 100.25],
            "NOT (status = 'failure')": [r for r in rows if r[3] not in ("failure", None)],
            "status = 'success' OR timestamp = 1": [r for r in rows if r[3] == "success" or r[4] == 1],
        }
        for where, want in cases.items():
            assert sorted(r.event_id for r in read().filter(where).collect()) == sorted(r[0] for r in want), where
        found = read().filter("status = 'failure' AND timestamp >= 500")
        with contextlib.redirect_stdout(io.StringIO()) as out:
            found.explain("formatted")
        plan = out.getvalue()
        assert "EqualTo(status,failure), GreaterThanOrEqual(timestamp,500.0)" in plan.split("PushedFilters: ")[1].splitlines()[0] and " Filter " not in plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_pushed_filters_cut_the_rows_read(tmp_path):
    audit_file(f"{tmp_path}/a.db", [(f"e{k}", "r", "scan", "success", float(k), 1.0) for k in range(300)])
    reader = audit_db.AuditReader(str(tmp_path), 100)
    left = list(reader.pushFilters([audit_db.GreaterThanOrEqual(("timestamp",), 150.0), audit_db.EqualTo(("no_such",), 1)]))
    assert [len(list(reader.read(p))) for p in reader.partitions()] == [0, 50, 100] and len(left) == 1
