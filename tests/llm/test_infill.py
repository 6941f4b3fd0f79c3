"""Fill-in-the-middle examples against a plain version with a regular expression, and rebuilt texts."""

from __future__ import annotations

import hashlib
import random
import re

import __spark_entry__ as entry
import duckdb
from pyspark.sql import functions as F

from tessera.llm import infill

SF = "/root/testdata/sf0.01"


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(x), len(y), "<S>" + z + "<P>" + x + "<M>" + y
    return n, "psm", len(x), len(y), "<P>" + x + "<S>" + z + "<M>" + y


def texts():
    rng = random.Random(5)
    alphabet = ["a", "Z", "bc", " ", "\n", "é", "日", "😀", "1", "<", "P", "S", "M", ">", "İ", "[", "`", "{", "@"]
    made = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(600)]
    return [None, "", "<P>", "x <M> y", "ab", " ", "é" * 3000, "word " * 50_000, "a" * 300_000, "<<S", "<", *made, *made[:20]]


def test_against_plain_version(spark, monkeypatch):
    rows = [(k if k % 7 else None, x, "own") for k, x in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").withColumn("draws", F.lit(1)).withColumn("n", F.lit("x"))
    made = infill.infill(docs, texts_at_once=7)
    assert made.columns == ["doc_id", "text", "draws", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and all(r.back == (r.text or "") and r.draws == 1 for r in got)
    assert sorted([(r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got], key=str) == sorted([(i, x, plain(i, x)) for i, x, _ in rows], key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_runs_over_slices(monkeypatch):
    monkeypatch.setattr(infill, "SLICE", 3)
    for text in texts()[:200]:
        text = (text or "")[:500]
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
        runs = infill.Runs(text)
        assert len(runs) == len(units)
        assert [runs.cut(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_query_and_its_sql(spark):
    got = entry.queries()["op11_infill"](spark, SF)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.sql(entry.oracle_sql()["op11_infill"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.select(*got.columns).fetchall(), key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert infill.infill(empty).count() == 0
