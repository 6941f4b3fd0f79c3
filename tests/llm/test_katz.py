"""Katz model against a plain version, and exact normalisation."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import katz
from tessera.llm.queries import op1_katz


def tokens(text):
    return [None, *re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()), "end"]


def plain_discounts(counts):
    """Katz's factors of 1 .. 5, written from the formula: (r*/r - 6 n6/n1) / (1 - 6 n6/n1) with r* = (r + 1) n(r+1) / n(r)."""
    n, out = Counter(counts), []
    for r in range(1, 6):
        d = -1
        if n[1] and n[r] and 6 * n[6] != n[1]:
            far = 6 * n[6] / n[1]
            d = ((r + 1) * n[r + 1] / n[r] / r - far) / (1 - far) if far < 1 else -1
        out.append(d if 0 < d < 1 else 1 - 0.5 / r)
    return out


class Plain:
    def __init__(self, texts):
        self.two = Counter(p for t in texts for p in zip(tokens(t), tokens(t)[1:], strict=False))
        self.one = Counter()
        for (_, w), c in self.two.items():
            self.one[w] += c
        self.n = sum(self.one.values())
        self.d1, self.d2 = (plain_discounts(x.values()) for x in (self.one, self.two))
        cut = lambda c, d: c * d[c - 1] if c <= 5 else c
        self.p1 = {w: cut(c, self.d1) for w, c in self.one.items()}
        den = self.n + (0.5 if sum(self.p1.values()) >= self.n else 0)
        self.p1 = {w: m / den for w, m in self.p1.items()}
        self.unknown = 1 - sum(self.p1.values())
        self.p2, self.alpha = {}, {}
        for h in {h for h, _ in self.two}:
            own = {w: c for (g, w), c in self.two.items() if g == h}
            mass = {w: cut(c, self.d2) for w, c in own.items()}
            den = sum(own.values()) + (0.5 if sum(mass.values()) >= sum(own.values()) else 0)
            self.p2 |= {(h, w): m / den for w, m in mass.items()}
            self.alpha[h] = (1 - sum(mass.values()) / den) / (1 - sum(self.p1[w] for w in own))

    def p(self, h, w):
        return self.p2[h, w] if (h, w) in self.p2 else self.alpha.get(h, 1.0) * self.p1.get(w, self.unknown)


def check(got, rows, plain, learned):
    assert len(got) == len(rows)
    got = {x.key: x for x in got}
    for i, text in rows:
        own, x = tokens(text), got[i]
        score = sum(math.log10(plain.p(h, w)) for h, w in zip(own, own[1:], strict=False))
        base = sum(math.log10((plain.one[w] + 0.5) / (plain.n + 0.5 * (len(plain.one) + 1))) for w in own[1:])
        assert x.learn == learned(i) and x.n_tokens == len(own) - 1 and x.n_known == sum(plain.one[w] > 0 for w in own[1:])
        assert x.score == pytest.approx(score, rel=1e-9) and x.base_score == pytest.approx(base, rel=1e-9)


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_against_plain_version(spark, tmp_path, block):
    r = random.Random(8)
    vocab = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for i in range(120)] + [(200, None), (201, ""), (202, "É\tW1 new\n"), (203, "w1 " * 30_000)]
    learned = lambda i: i < 90 or i == 203
    docs = spark.createDataFrame(rows, "key long, text string").selectExpr("*", "key < 90 OR key = 203 AS learn", "1 AS n", "2 AS w", "'x' AS data")
    model = katz.Model(docs, str(tmp_path / "m"), block)
    plain = Plain([t for i, t in rows if learned(i)])
    assert (model.tokens, model.types) == (plain.n, len(plain.one))
    assert len(model.spread) > 1  # w1 is dealt out
    check(model.score().collect(), rows, plain, learned)
    for h in [None, b"w1", b"w2", b"unseen", b"\xc3\x89"]:
        assert sum(plain.p(h, w) for w in [*plain.one, "unknown"]) == pytest.approx(1)


def test_query_columns(spark, tmp_path):
    """Over the whole small table: folds, counts and scores as the contract has them; null ids are learned from, repeated rows stay."""
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    more = docs.limit(3).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    plain = Plain([x.text for x in rows if not held(x.doc_id)])
    want = []
    for i, text in rows:
        own = tokens(text)
        want.append((i is None, i or 0, held(i), len(own) - 1, plain.n, round(sum(math.log10(plain.p(h, w)) for h, w in zip(own, own[1:], strict=False)), 6)))
    got = [(x.doc_id is None, x.doc_id or 0, x.held_out, x.n_tokens, x.train_tokens, round(x.score, 6)) for x in op1_katz(spark, str(tmp_path)).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-5)


def test_nothing_to_learn_from(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "a b")], "key long, learn boolean, text string")
    row = katz.Model(docs, str(tmp_path / "m")).score().first()
    assert (row.n_tokens, row.n_known, row.score) == (3, 0, 0.0)
    assert katz.Model(docs.limit(0), str(tmp_path / "n")).score().count() == 0


def test_packing():
    r = random.Random(1)
    arrays = [np.array([r.randint(-(2**63), 2**63 - 1) for _ in range(9)]), np.zeros(0, np.int64), np.array([0.1, -3e300, np.nan])]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True):
        np.testing.assert_array_equal(a, b)
