"""The pipeline on the small tables against plain versions of its stages."""

from __future__ import annotations

import corpus_pipeline
import test_jaccard
import test_lines

from tessera.llm import decontamination, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scorer = toxicity.Scorer(*toxicity.train(docs, labels))
    rows = {i: t for i, t in rows.items() if scorer([t])[0] < 0.5}
    flat = list(rows.items())
    cut = test_lines.brute(flat, 50)
    flat = [(i, cut[n]) for n, (i, _) in enumerate(flat)]
    group = {i: c for i, _, c in test_jaccard.brute(flat, 5, 80)}
    flat = [(i, t) for i, t in flat if group[i] == i]
    bench = [(r.item_id, decontamination.normalise(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontamination.Matcher([(i, x) for i, x in bench ], 0.1, 40)
    flat = [(i, t) for i, t in flat if not matcher.find(decontamination.normalise(t))]

    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert docs.columns == columns
    assert {(r.doc_id, r.decoded) for r in docs.collect()} == {(i, t.replace("▁", " ")) for i, t in flat}
    assert 0 < len(flat) < len(rows)
