"""Pigeonhole edit matching against brute force."""

from __future__ import annotations

import random

from tessera.llm import decontamination as d


def brute(item: str, text: str) -> int:
    """Least edit distance between item and any part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_is_exact():
    r = random.Random(1)
    for _ in range(200):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abc ") for _ in range(r.randint(0, 150)))
        assert d.Pattern(item).least(text) == brute(item, text)


def test_no_match_is_lost():
    r = random.Random(2)
    found = 0
    for _ in range(150):
        item = d.normalise("".join(r.choice("abcdefg ") for _ in range(r.randint(40, 120))))
        edited = list(item)
        for _ in range(r.randint(0, 14)):
            at = r.randrange(len(edited))
            edited[at : at + 1] = r.choice(["", r.choice("abc"), r.choice("xyz") + edited[at]])
        text = "".join(r.choice("abcdefg ") for _ in range(60)) + "".join(edited) + "".join(r.choice("abcdefg ") for _ in range(60))
        hit = d.Matcher([(7, item)], 0.1).find(text)
        least = brute(item, text)
        assert bool(hit) == (least <= int(0.1 * len(item)))
        found += bool(hit)
        if hit:
            assert hit[0][1] == least
    assert 20 < found < 150


def test_tables(spark):
    item = "That and onesen erblest it hein ti inenan eranenes whou therouou thon the."
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "short", "x"), (1, item, "x")], "item_id long, text string, doc_id string")
    rows = [(1, "pre " + item.upper() + " post"), (1, "pre " + item + " post"), (2, None), (3, ""), (None, item.replace("onesen", "onesn")), (4, "clean words " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS item_id", "7 AS leaks")
    got = sorted((r.doc_id or 0, r.item_id, r.errors) for r in d.contaminated(docs, bench, block_chars=80).collect())
    assert got == sorted([(1, 1, 0)] * 4 + [(0, 1, 1)] * 2)
    flags = d.flagged(docs, bench)
    assert flags.columns == docs.columns[:-1] + ["leaks"] and sorted(r.leaks for r in flags.collect()) == [0, 0, 0, 2, 2, 2]
    assert d.contaminated(docs, bench.limit(0)).count() == 0 and d.flagged(docs, bench.limit(0)).count() == 6
    assert d.contaminated(docs.limit(0), bench).count() == 0


def test_production_budget(spark):
    """At the default rate: passages with up to a tenth of their characters edited are found, with their least distance."""
    r = random.Random(5)
    words = ["".join(r.choice("aeionrst") for _ in range(r.randint(2, 6))) for _ in range(60)]
    phrase = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, phrase(r.randint(20, 60))) for k in range(8)]
    rows, want, between = [], set(), 0
    for n in range(80):
        edited = list(r.choice(items)[1])
        for _ in range(r.randint(0, int(0.13 * len(edited)))):
            at = r.randrange(len(edited))
            edited[at : at + 1] = r.choice(["", r.choice("xyz"), r.choice("xyz") + edited[at]])
        rows.append((n, phrase(30) + " " + "".join(edited) + " " + phrase(30)))
        for item, x in items:
            least = brute(x, d.normalise(rows[-1][1]))
            if least <= int(0.1 * len(x)):
                want.add((n, item, least))
                between += least > int(0.05 * len(x))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(f.doc_id, f.item_id, f.errors) for f in d.contaminated(docs, bench).collect()} == want
    assert between > 5
    assert sum(x.leaks for x in d.flagged(docs, bench).collect()) == len(want)


def whole_words(item, text, errors):
    """Least edit distance between item and any whole words of text."""
    words = text.split(" ") if text else []
    parts = (" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1))
    return min((d.distance(item, x) for x in parts if abs(len(x) - len(item)) <= errors), default=errors + 1)


def test_short_items(spark):
    assert [d.distance(a, b) for a, b in (("kitten", "sitting"), ("", "ab"), ("ab", "ab"))] == [3, 2, 0]
    r = random.Random(6)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(12)]
    items = [(k, d.normalise(" ".join(r.choice(words) for _ in range(r.randint(1, 9))))) for k in range(30)]
    items = [(k, x) for k, x in items if len(x) < 40]
    rows, want = [(n, " ".join(r.choice(words) for _ in range(r.randint(0, 25)))) for n in range(25)], set()
    for n in range(60):
        edited = list(r.choice(items)[1])
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(edited) + 1)
            edited[at : at + 1] = r.choice(["", "c", "a ", "bb"])
        rows.append((100 + n, r.choice(["", "ab ", "x"]) + "".join(edited) + r.choice(["", " ba", "y"])))
    for n, text in rows:
        for k, x in items:
            least = whole_words(x, d.normalise(text), int(0.1 * len(x)))
            if least <= int(0.1 * len(x)):
                want.add((n, k, least))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (90, "?!"), (91, None)], "item_id long, text string")
    assert {(f.doc_id, f.item_id, f.errors) for f in d.contaminated(docs, bench).collect()} == want
    assert {e for _, _, e in want} >= {0, 1}
    assert sum(x.leaks for x in d.flagged(docs, bench).collect()) == len(want)
