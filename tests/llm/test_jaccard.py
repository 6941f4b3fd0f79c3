"""Jaccard components against brute force."""

from __future__ import annotations

import random
import re

import pytest

from tessera.llm import jaccard


def brute(rows, n, percent):
    def grams(text):
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()

    sets = [grams(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else doc))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_against_brute_force(spark, tmp_path, n, percent):
    r = random.Random(n)
    vocab = [f"w{k}" for k in range(200)]
    base = [[r.choice(vocab) for _ in range(r.randint(1, 120))] for _ in range(25)]
    rows = []
    for k in range(220):
        words = list(base[0] if k % 3 == 0 else r.choice(base))
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((k, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "One\ttwo "), (503, "one two"), (None, "one two"), (None, "alone here"), (505, "long " * 20_000), (506, "É é É é É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS cls", "3 AS token")
    got = jaccard.near_duplicates(df, str(tmp_path / "j"), n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, n, percent)


def test_empty_table(spark, tmp_path):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e")).count() == 0


def test_one_of_each_group_stays(spark, tmp_path):
    rows = [(3, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (2, None, 3), (2, None, 3), (None, "other words", 4), (4, "a b c d e x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, print int")
    kept = jaccard.keep_one(df, str(tmp_path / "k"))
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5], rows[6]], key=str)
