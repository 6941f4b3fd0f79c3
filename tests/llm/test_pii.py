"""Base spans against Python's re, and defined cases."""

from __future__ import annotations

import hashlib
import random
import re

from tessera.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(spark, texts, tmp):
    df = spark.createDataFrame([(n, x) for n, x in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS cands", "2 AS kind")
    import unittest.mock as mock

    with mock.patch.object(queries, "table", lambda *_: df):
        got = {r.doc_id: r for r in queries.op4_pii(spark, tmp).collect()}
    for n, text in enumerate(texts):
        want = brute(text)
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[n].base_sha256 == hashlib.sha256(named.encode()).hexdigest(), (text, named, got[n].spans)
        assert [got[n][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert set(filter(None, named.split(","))) <= set(got[n].spans.split(","))
    return got


def test_against_re(spark, tmp_path):
    r = random.Random(6)
    texts = ["".join(r.choice("aB1290.@@+-_% ()é🙂\n\x01") for _ in range(r.randint(0, 80))) for _ in range(300)]
    texts += ["".join(r.choice("0123456789.+- @a") for _ in range(r.randint(0, 200))) for _ in range(200)]
    texts += ["4111111111111111", "4111 1111 1111 1111 x", "a4111-1111-1111-1111", "+1 (503) 555-8963", "1.2.3.4.5.6.7.8", "256.1.1.1 000255.0.0.1", "a@b.c+d@e.f", "a@b.c.@x.y@z.w", "🙂 rhs.42@mail6.example.com é", None, ""]
    check(spark, texts, str(tmp_path))


def test_very_long_runs(spark, tmp_path):
    check(spark, ["1" * 3000, "1 " * 3000, "a" * 3000 + "@b", "+" + "1" * 3000, "1." * 3000, "x@y" + ".z" * 3000, "+1 " * 3000], str(tmp_path))
    long = ["1" * 200_000, "1 " * 50_000, "a" * 200_000 + "@b", "+" + "1" * 100_000, "1." * 20_000, "x@y" + ".z" * 50_000]  # too long for re
    got = pii.candidates(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).selectExpr("doc_id", "size(filter(cands, c -> c.base)) AS n").collect()
    assert {r.doc_id: r.n for r in got} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 5000, 5: 1}


def test_added_spans_and_redaction(spark, tmp_path):
    texts = [f'mail{n} rhs.{n}@mail6.example.com token = "{n:04d}1e13db8ab71b41a6803e722e76d21eb" end' for n in range(40)] + [f"password=79f30{n}40bf02a602472 x 10.0.0.{n} y" for n in range(40)]
    got = check(spark, texts, str(tmp_path))
    assert all("secret:" in r.spans for r in got.values())
    docs = spark.createDataFrame([(0, "mail rhs.42@mail6.example.com ok")], "doc_id long, text string")
    cands = pii.candidates(docs)
    assert pii.redact(docs, pii.spans(cands, [])).first().text == "mail [email] ok"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    cands = pii.candidates(docs)
    assert pii.spans(cands, pii.fit(cands)).count() == 0


def test_added_spans_are_found(spark, tmp_path):
    """Recall of planted secrets and national phone numbers, which are no base spans; decoys that fail the checksum stay out."""
    from tessera.llm.common import stored, table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    cands = stored(pii.candidates(docs), str(tmp_path / "c"))
    got = {r.doc_id: {tuple(x) for x in r.spans} for r in pii.spans(cands, pii.fit(cands)).collect()}
    planted = found = decoys = 0
    for r in docs.collect():
        text = r.text or ""
        for kind, pattern in ((4, r'token = "[0-9a-f]{40}'), (3, r"(?<![0-9] )\([0-9]{3}\) [0-9]{3}-[0-9]{4}")):
            for m in re.finditer(pattern, text):
                planted += 1
                found += any(k == kind and a <= m.start() and m.end() <= b for k, a, b in got[r.doc_id])
        for m in re.finditer(r"(?<![0-9])[0-9]{16}(?![0-9])", text):
            decoys += not luhn(m[0]) and any(k == 2 and a <= m.start() < b for k, a, b in got[r.doc_id])
    assert planted >= 10 and found >= 0.9 * planted and decoys == 0


def test_reliabilities_against_a_known_mixture():
    """EM finds the labelers' reliabilities that votes were drawn with."""
    r = random.Random(1)
    votes = {}
    for _ in range(20_000):
        y = r.random() < 0.6
        v = tuple((1 if (r.random() < p) == y else -1) for p in (0.95, 0.9, 0.85, 0.8, 0.75, 0.7))
        votes[v] = votes.get(v, 0) + 1
    right, prior, _ = pii.reliabilities(sorted(votes.items()))
    assert abs(prior - 0.6) < 0.03
    assert all(abs(a - p) < 0.04 and abs(b - p) < 0.04 for (a, b), p in zip(right, (0.95, 0.9, 0.85, 0.8, 0.75, 0.7), strict=True))
