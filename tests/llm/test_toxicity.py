"""Toxicity scores: held-out accuracy and defined cases."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = queries.op3_toxicity(spark, SF)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    assert scored.count() == 1000 and len(rows) > 50
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (1, None, 5.0), (2, "", 1.0), (None, "x", 0.0), (3, "a" * 100_000, 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 5 and {r.predicted for r in got} == {0}
    empty = docs.filter(F.lit(False))
    assert toxicity.score(empty, toxicity.train(empty, labels.filter(F.lit(False)))).count() == 0


def test_scores_add_up_over_grams():
    words = ["abc", "é" * 30, "xy"]
    bucket, owner = toxicity.gram_buckets(words)
    assert (np.bincount(owner) == [sum(max(0, len(w) + 3 - n) for n in toxicity.ORDERS) for w in words]).all()
    alone = toxicity.gram_buckets(["abc"])[0]
    assert sorted(alone) == sorted(bucket[owner == 0])


def test_scores_against_plain_sums():
    """Score and features of a text by plain loops over its words and their n-grams."""
    r = np.random.default_rng(3)
    weights = (0.1 * r.normal(size=1 << toxicity.BITS)).astype(np.float32)
    scorer = toxicity.Scorer(weights, -0.25)
    for text in ("", "Ab ab éé", "one two two three " * 50, "x" * 3000, None):
        words = toxicity.WORD.findall((text or "").lower())
        grams = [int(b) for w in words for b in toxicity.gram_buckets([w])[0]]
        z = sum(float(weights[b]) for b in grams) / max(1, len(words)) - 0.25
        assert abs(scorer([text])[0] - 1 / (1 + np.exp(-z))) < 1e-6
        bucket, value = toxicity.features(toxicity.words_of(text))
        assert bucket.tolist() == sorted(set(grams))
        assert np.allclose(value, [100 * grams.count(b) / max(1, len(words)) for b in bucket])


def test_long_clean_texts_stay_clean(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "text", "toxic")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    clean = [r.text or "" for r in docs.filter("toxic = 0").orderBy("doc_id").collect()]
    scorer = toxicity.Scorer(*model)
    for size in (20, 50):
        assert max(scorer([" ".join(clean[k : k + size]) for k in range(0, len(clean), size)])) < 0.5
    toxic = [r.text for r in docs.filter("toxic = 1").collect()]
    assert np.mean(np.array(scorer(toxic)) >= 0.5) > 0.9


def test_repeated_rows_and_ties(spark):
    docs = spark.createDataFrame([(k % 4, f"fine words number {k % 4}" if k % 2 else f"nasty trash {k % 4}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    once = toxicity.score(docs.distinct(), toxicity.train(docs.distinct(), labels)).collect()
    many = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in once} == {(r.doc_id, round(r.score, 9)) for r in many} and len(many) == 40
    assert {r.doc_id: r.predicted for r in many} == {0: 1, 1: 0, 2: 1, 3: 0}


def test_fit_holds_few_bytes_a_feature():
    r = np.random.default_rng(5)
    texts = [" ".join("".join(map(chr, r.integers(97, 123, 6))) for _ in range(300)) for _ in range(500)]
    n = sum(len(toxicity.features(toxicity.words_of(x))[0]) for x in texts)
    tracemalloc.start()
    toxicity.fit(texts, np.arange(500) % 2.0, 0.5, rounds=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * n + 100 * (1 << toxicity.BITS)
