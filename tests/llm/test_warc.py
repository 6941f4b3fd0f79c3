"""WARC round trips against plain Python."""

from __future__ import annotations

import hashlib

from tessera.llm import warc


def brute(rows, least):
    out = []
    by: dict = {}
    for n, (i, _, html) in enumerate(rows):
        by.setdefault((html or "").encode(), []).append((i is not None, i or 0, n))
    for n, (i, _, html) in enumerate(rows):
        data = (html or "").encode()
        first = max(by[data])
        revisit = len(data) >= least and n != first[2]
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", rows[first[2]][0] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://a/\r\nX: y", big), (7, "u", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (8, "u", "short"), (None, "u", "x" * 1200), (9, "u", "x" * 1200), (10, "u", "z" * 300_000), (11, "u", "<a>\r\n\r\nWARC/1.1\r\n")]
    rows += [(20, "u", "same" * 300)] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS digest", "1 AS size", "2 AS row_id")
    path = f"file://{tmp_path}/w"
    index = warc.write_archives(warc.plan_records(df, 1000), path, roll_bytes=2000)
    back = warc.read_records(index, path, gap=100, most=5000).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)
    want = brute(rows, 1000)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x for x in got if x[0] != 20] == [x for x in want if x[0] != 20]
    assert sorted(x[3] for x in got if x[0] == 20) == ["response", "revisit", "revisit"]
    assert all(bytes(r.payload) == (dict((i, h) for i, _, h in rows)[r.page_id] or "").encode() for r in back if r.record_type == "response")
    one = warc.read_records(index.filter("page_id = 7"), path).collect()
    assert len(one) == 1 and bytes(one[0].payload) == big.encode()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"file://{tmp_path}/e"
    assert warc.read_records(warc.write_archives(warc.plan_records(df, 1000), path), path).count() == 0


def test_ranges_are_joined():
    assert warc.coalesce_ranges([(0, 10), (10, 5), (30, 5), (36, 4)], 2, 100) == [(0, 15, [0, 1]), (30, 40, [2, 3])]
    assert warc.coalesce_ranges([(0, 10), (10, 10)], 5, 15) == [(0, 10, [0]), (10, 20, [1])]
