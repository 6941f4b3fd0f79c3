"""Maximal conversations against brute force."""

from __future__ import annotations

import random

from tessera.llm import chat


def brute(rows):
    by: dict = {}
    for conv, turn, role, text in {(c, t, r or "", x or "") for c, t, r, x in rows}:
        by.setdefault(conv, []).append((turn, role, text))
    seqs = {c: tuple((r, x) for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))) for c, v in by.items()}
    prefixes = {s[:k] for s in seqs.values() for k in range(1, len(s))}
    return {(min((c for c, t in seqs.items() if t == s), key=lambda c: (c is not None, c or 0)), len(s), sum(t == s for t in seqs.values()), "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in s)) for s in seqs.values() if s not in prefixes}


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None])) for c in range(60) for t in range(r.randint(1, 5))]
    rows += rows[:20] + [(None, 1, "user", "a"), (None, None, "user", "z" * 50_000), (7, 1, "user", "tie"), (7, 1, "user", "tie2")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS digest", "2 AS id", "3 AS n_turns")
    assert {tuple(x) for x in chat.render(df).collect()} == brute(rows)
    assert chat.render(df.limit(0)).count() == 0


def test_long_conversation_and_its_snapshots(spark):
    """More turns than one block of digests; null ids, repeated rows and extra columns."""
    full = [("user" if k % 2 else "assistant", f"turn {k}") for k in range(200)]
    rows = [(c, t, *full[t]) for c, size in ((1, 63), (2, 64), (3, 65), (4, 200), (5, 200)) for t in range(size)]
    rows += [(None, 0, None, None), (None, 0, None, None)] + rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS n_turns", "2 AS id", "3 AS lines")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.render(df).collect()}
    assert got == {4: (200, 2, "".join(f"<|{a}|>\n{b}\n<|end|>\n" for a, b in full)), None: (1, 1, "<||>\n\n<|end|>\n")}
    assert chat.render(df.limit(0)).count() == 0
