"""Names and functions that are alike against the standard library over all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from tessera.functions import parsing
from tessera.operators import similarity as s
from tessera.sources import views as v

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_bounds_lose_no_pair(spark):
    rng = random.Random(3)
    names = ["", "a", "aa", "aaaa", "numpy", "nunpy", "é日😀x", "😀é日x", "x" * 250, "x" * 240 + "y" * 10]
    names += ["".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(90)]
    left, right = [*names[:60], None, "a"], [*names[30:], *names[:10], None]
    a, b = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (left, right))
    for least in (0.3, 0.7, 0.9):
        got = {(r.left, r.right): r.ratio for r in s.close_names(a, b, least).collect()}
        assert got == {(x, y): q for x in set(left) - {None, ""} for y in set(right) - {None, ""} if (q := ratio(x, y)) > least}


def test_upper_bound(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("abce", k=rng.randrange(9))), "".join(rng.choices("abce", k=rng.randrange(9)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in s.with_ratio(df.withColumn("most", s.most_ratio(s.letters(F.col("a")), s.letters(F.col("b")))), "a", "b").collect():
        assert r.ratio == ratio(r.a, r.b) <= r.most + 1e-12


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def score(a, b):
    def parts(n):
        return {p for p in (n.lower().split("_") if "_" in n else [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)", n)]) if p}

    names = lambda f: {p.split(":")[0].strip() for p in f.parameters} - {"self", "cls"}
    words = lambda f: set(re.findall(r"\w+", (f.docstring or "").lower())) - set(s.STOP_WORDS)
    pairs = [(ratio(a.name.lower(), b.name.lower()), 0.4, 0.3), (jaccard(parts(a.name), parts(b.name)), 0.3, 0.5), (jaccard(names(a), names(b)), 0.2, 0.3), (jaccard(words(a), words(b)), 0.2, 0.3), (jaccard(set(a.decorators), set(b.decorators)), 0.2, 0.5)]
    return min(sum(value * weight for value, weight, above in pairs if value > above), 1.0)


def best(functions, asked, k):
    out = {}
    for a in asked:
        scored = sorted((-round(score(a, b), 12), b.path, b.name, b.line) for b in functions if (b.path, b.name) != (a.path, a.name))
        out[a.path, a.name] = [(p, n, -q) for q, p, n, _ in scored[:k] if -q >= 0.3]
    return out


SOURCE = '''
@cache
def load_user(self, user_id: int, db): "Load the user of an id"
@cache
def load_users(self, ids: list, db): "Load users of ids"
def loadUser(cls, user_id): pass
def save(x): "Save"
def getHTTPServer(): pass
async def load_user_data(user_id, db=None): "Load data of the user"
class A:
    @staticmethod
    def load_user(user_id): "Load"
'''


@pytest.mark.parametrize("k", [2, 10])
def test_neighbours(spark, k):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", SOURCE.replace("user", "client")), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    functions = parsing.signatures(files)
    rows = functions.collect()
    got = {}
    for r in sorted(s.neighbours(functions, functions, k).collect(), key=lambda r: r["rank"]):
        got.setdefault((r.path, r.name), []).append((r.other_path, r.other_name, round(r.score, 12)))
    want = best(rows, rows, k)
    once = Counter((r.path, r.name) for r in rows)
    assert len(rows) == 14 and all(got.get(key, []) == want[key] for key, n in once.items() if n == 1)


def test_queries(spark):
    files = v.src(spark, SF)
    rows = parsing.signatures(files.select("path", F.col("code").alias("text"))).collect()
    asked = {r.path for r in files.filter("file_id % 20 = 0").collect()}
    got = {}
    for r in sorted(entry.queries()["semantic_neighbours"](spark, SF).collect(), key=lambda r: r["rank"]):
        got.setdefault((r.path, r.name), []).append((r.other_path, r.other_name, round(r.score, 12)))
    assert len(rows) == 200 and got == {k: w for k, w in best(rows, [r for r in rows if r.path in asked], 10).items() if w}
    count = Counter(w for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()) if len(w) > 4)
    popular = sorted(count, key=lambda w: (-count[w], w))[:100]
    want = {}
    for w in count:
        close = sorted((-q, p) for p in popular if 0.7 < (q := ratio(w, p)) < 1)
        if close:
            want[w] = close[0][1], -close[0][0]
    found = entry.queries()["typosquat_ratio"](spark, SF).collect()
    assert {r.name: (r.popular, r.ratio) for r in found} == want and len(want) > 20
    assert {r.risk for r in found} <= {"CRITICAL", "HIGH", "MEDIUM", "LOW"}


def test_kinds(spark):
    pairs = [("1odash", "lodash", "visual_similarity"), ("rquests", "requests", "missing_char"), ("numpyy", "numpy", "extra_char"), ("pnadas", "pandas", "transposition"), ("flaxk", "flask", "character_swap"), ("scipyzzz", "scipy", "other")]
    df = spark.createDataFrame(pairs, "a string, b string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", s.typo_kind(F.col("a"), F.col("b"))).collect())


def test_neighbours_meet_in_blocks(spark, monkeypatch, capsys):
    """Pairs are no rows of a join, asked functions may come from the same table, and blocks and chunks of any size give one result."""
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", SOURCE.replace("user", "client"))], "path string, text string")
    functions = parsing.signatures(files)
    asked = functions.join(files.filter("path = 'a.py'").select("path"), "path", "left_semi")
    whole = s.neighbours(asked, functions, 3)
    whole.explain()
    assert "FlatMapCoGroupsInArrow" in (plan := capsys.readouterr().out) and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    monkeypatch.setattr(s, "BLOCK", 2)
    monkeypatch.setattr(s, "CHUNK", 2)
    assert sorted(s.neighbours(asked, functions, 3).collect()) == sorted(whole.collect()) and whole.count() > 10


def test_names_meet_in_blocks(spark, monkeypatch, capsys):
    """No row is a pair that bounds rule out, and blocks and cells of any size give one result, also for names of more than 63 letters."""
    rng = random.Random(8)
    names = ["".join(rng.choices("abé😀", k=rng.choice((1, 3, 6, 9, 62, 63, 64, 65, 70, 300)))) for _ in range(80)]
    names += [n[:5] + "z" + n[5:] for n in names[:40]]
    a, b = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (names, names[::3]))
    want = {(x, y): q for x in set(names) for y in set(names[::3]) if (q := ratio(x, y)) > 0.7}
    found = s.close_names(a, b, 0.7)
    assert {(r.left, r.right): r.ratio for r in found.collect()} == want and len(want) > 60
    found.explain()
    assert "FlatMapCoGroupsInArrow" in (plan := capsys.readouterr().out) and not any(x in plan for x in ("SortMergeJoin", "BroadcastHashJoin", "CartesianProduct", "NestedLoop"))
    monkeypatch.setattr(s, "NAMES", 16)
    monkeypatch.setattr(s, "CELLS", 700)
    monkeypatch.setattr(s, "OTHERS", 8)
    assert sorted(s.close_names(a, b, 0.7).collect()) == sorted(found.collect())


def test_few_names_are_matched(monkeypatch):
    """Of names with the same letters in other orders few are matched by blocks, and the best are those of all pairs, also with long
    and equal names and with parts in common."""
    import itertools
    import json
    from types import SimpleNamespace

    import pyarrow as pa

    rng = random.Random(5)
    names = ["f" + "".join(p) for p in itertools.permutations("123456")]
    names += ["_".join(rng.choices(("load", "user", "é1", "A22", "x" * 40), k=rng.randrange(1, 5))) + rng.choice(("", "1", "12", "_21")) for _ in range(300)]
    pick = lambda xs: rng.sample(xs, rng.randrange(len(xs) + 1))
    functions = [SimpleNamespace(path=f"p{i % 7}", name=n, line=i, parameters=pick(["a", "b", "c"]), docstring=" ".join(pick(["read", "all", "rows"])), decorators=pick(["@x"])) for i, n in enumerate(names)]
    parts = lambda n: sorted({p for p in (n.lower().split("_") if "_" in n else [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)", n)]) if p})
    row = lambda f: {"path": f.path, "name": f.name, "line": f.line, "low": f.name.lower(), "parts": parts(f.name), "sets": json.dumps({"names": f.parameters, "words": f.docstring.split(), "marks": f.decorators})}
    asked = functions[::25]
    own, others = (pa.Table.from_pylist([row(f) for f in fs]) for fs in (asked, functions))
    matched = []

    class Counted(SequenceMatcher):
        def ratio(self):
            matched.append(1)
            return super().ratio()

    monkeypatch.setattr(s, "SequenceMatcher", Counted)
    monkeypatch.setattr(s, "AT_ONCE", 50)
    found = list(s._best_of(own, others, 4, 0.3))
    assert len(matched) < len(asked) * len(functions) / 8
    for i, a in enumerate(asked):
        scores = {(b.path, b.name, b.line): round(score(a, b), 12) for b in functions if (b.path, b.name) != (a.path, a.name)}
        mine = [(key, round(q, 12)) for x, key, q in found if x == i]
        assert [q for _, q in mine] == [q for q in sorted(scores.values(), reverse=True)[:4] if q >= 0.3] and all(scores[key] == q for key, q in mine)
