"""Repaired conversations against a plain version that tries the edits of each row, shortest cost and least letters first."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib

from tessera.llm import queries, repair

SF = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"


def exhaustive(rows):
    """(cost, audit, result) by trying all sequences of edits. rows: (initial, fault)."""
    best = None
    gaps = range(len(rows) + 1)
    for inserts in itertools.product(range(4), repeat=len(rows) + 1):
        if sum(inserts) > 3:
            continue
        for edits in itertools.product("DKR", repeat=len(rows)):
            if any(e != "D" and f in "bd" for e, (_, f) in zip(edits, rows, strict=True)):
                continue
            letters = "".join("I" * inserts[k] + (edits[k] if k < len(rows) else "") for k in gaps)
            options = [o for k in gaps for o in ["ua"] * inserts[k] + ([{"D": None, "K": rows[k][0], "R": "ua"}[edits[k]]] if k < len(rows) else []) if o]
            cost = 5 * sum(inserts) + sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (f == "t" and e != "D") for e, (_, f) in zip(edits, rows, strict=True))
            if (best is None or (cost, letters) < best) and any(re.fullmatch("(s?(ua)+)?", "".join(c)) for c in itertools.product(*options)):
                best = cost, letters
    return best


def test_solver_against_exhaustive_search():
    rng = random.Random(1)
    fault = {"n": repair.NONE, "b": repair.BLANK, "d": repair.DUPLICATE, "t": repair.TRUNCATED}
    kinds = [*itertools.product(*["suao"] * 2), *(tuple(rng.choices("suao", k=rng.randrange(5))) for _ in range(150))]
    for roles in kinds:
        rows = [(r, rng.choice("nnnntbd")) for r in roles]
        letters = "".join(chr(65 + 4 * "suao".index(r) + fault[f]) for r, f in rows)
        assert repair.solve(letters) == exhaustive(rows), rows


def damaged(rows):
    out = []
    one = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = "user" if draw == 4 else one(role), "" if draw == 1 else re.sub("[.!?]", "", one(text)) if draw == 2 else one(text)
        out += [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


@functools.cache
def cheapest(rows):
    """(cost, audit, roles) of the cheapest edits by recursion over all of them; at most two inserts in a row are ever of use."""

    @functools.cache
    def best(i, done, added):
        ways = []
        head = "".join(done)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", head):
            ways.append((0, "", ()))
        step = lambda c, letter, new, j, k: [] if (w := best(j, new, k)) is None else [(c + w[0], letter + w[1], ((letter, new),) + w[2])]
        if added < 2:
            for r in "ua":
                if (new := grown(head, r)) is not None:
                    ways += step(5, "I", new, i, added + 1)
        if i < len(rows):
            r, f = rows[i]
            ways += step(2, "D", done, i + 1, 0)
            if f not in "bd":
                extra = 5 if f == "t" else 0
                if (new := grown(head, r)) is not None:
                    ways += step(extra, "K", new, i + 1, 0)
                for x in "ua":
                    if (new := grown(head, x)) is not None:
                        ways += step(1 + extra, "R", new, i + 1, 0)
        return min(ways, default=None)

    return best(0, (), 0)


def grown(head, r):
    """The last state's name after one more initial: what stands before matters only as far as the structure goes."""
    ok = {"": "su", "s": "u", "u": "a", "su": "a", "ua": "u", "sua": "u"}
    if r not in ok[head]:
        return None
    return tuple({"": r, "s": "su", "u": "ua", "su": "sua", "ua": "u", "sua": "su"}[head])


def plain(rows):
    """What the query returns for the rows before damage."""
    found = {conv: [] for conv, *_ in rows}
    for row in damaged(rows):
        found[row[0]].append(row)
    out = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            end = text.rstrip(WHITE)[-1:]
            faults.append("b" if not end else "d" if (role, text) in seen else "t" if end not in ".!?" else "n")
            seen.add((role, text))
        heads = [r[2][:1] if r[2][:1] in tuple("sua") else "o" for r in own]
        cost, audit, steps = cheapest(tuple(zip(heads, faults, strict=True)))
        left, k = [], 0
        for letter, new in steps:
            _, _, role, text = own[k] if letter != "I" else (0, 0, "", "")
            name = {"u": "user", "a": "assistant"}.get(new[-1] if new else "")
            left += [] if letter == "D" else [f"{role}:{text}" if letter == "K" else f"{name}:{text}"]
            k += letter != "I"
        turns = [t for _, t, _, _ in own if t is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def same(spark, rows, path):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string")
    got = repair.report(repair.damage(df), df, f"file://{path}").select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


def test_hostile_conversations(spark, tmp_path):
    rng = random.Random(2)
    words = [None, "", " ", "\t\n", "Yes.", "No", "Why?\n ", "é日!", "x ", "a.b", "."]
    rows = [(rng.choice([None, *range(150)]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice(words)) for _ in range(900)]
    same(spark, rows + rows[:50] + [(500, 1, "user", "long " * 50_000 + "."), (500, 2, "assistant", "y.")], tmp_path / "a")


def test_long_conversations_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 3)
    rng = random.Random(4)
    rows = [(c, k, rng.choice(["user", "assistant"]), f"turn {rng.randrange(300)}{rng.choice('.!x')}") for c in (1, None) for k in range(90)]
    same(spark, rows, tmp_path / "b")


def test_whole_table_and_repaired_rows(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    got = queries.op13_repair(spark, SF)
    assert set(got.columns) == set(COLUMNS)
    found = sorted(map(tuple, got.select(*COLUMNS).collect()))
    assert found == sorted(plain(rows)) and len(found) == 100
    ordered = repair.in_order(repair.damage(table), f"file://{tmp_path}/r")
    kept = repair.repaired(ordered, repair.audits(repair.letters(ordered))).orderBy("conv_id", "place").collect()
    for conv, *_, digest in found:
        own = [f"{r.role}:{r.text}" for r in kept if r.conv_id == conv]
        assert hashlib.sha256("\n".join(own).encode()).hexdigest() == digest


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(repair.damage(df), df, f"file://{tmp_path}/e").count() == 0
    gone = next((c, t) for c in range(99) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*gone, "user", "x")], df.schema)
    assert [tuple(r) for r in repair.report(repair.damage(df), df, f"file://{tmp_path}/g").select(*COLUMNS).collect()] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
