"""Line dedup against brute force."""

from __future__ import annotations

import random

from tessera.llm import lines


def brute(rows, min_words):
    """Rows (id, text) without the lines of the longest runs with a copy that ends before them: at each line of the corpus the
    longest common prefix with every earlier line's suffix that does not reach it; runs of min_words words or more go."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, n))
    corpus = []  # (row, position, line) with a separator that equals nothing between rows
    for n in order:
        corpus += [(n, k, x) for k, x in enumerate((rows[n][1] or "").split("\n")) if x.strip(" ")] + [(n, -1, object())]
    where = {}
    gone = {n: set() for n in order}
    for p, (n, _, line) in enumerate(corpus):
        longest = 0
        for q in where.get(line, []):
            k = 0
            while q + k < p and corpus[q + k][2] == corpus[p + k][2]:
                k += 1
            longest = max(longest, k)
        run = corpus[p : p + longest]
        if sum(x.strip(" ").count(" ") + 1 for _, _, x in run) >= min_words:
            gone[n] |= set(range(run[0][1], run[-1][1] + 1))
        where.setdefault(line, []).append(p)
    return {n: None if rows[n][1] is None else "\n".join(x for k, x in enumerate(rows[n][1].split("\n")) if k not in gone[n]) for n in order}


def test_against_brute_force(spark, tmp_path):
    for seed in range(3):
        r = random.Random(seed)
        pool = ["x", "a b", "c d e", "f g", "", "one two three four five six seven", "é", "p q r s t"]
        rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.9 else f"own {i} {r.random()}" for _ in range(r.randint(0, 25)))) for i in range(40)]
        rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, None), (201, ""), (None, rows[3][1] + "\n" + "y " * 3000)]
        df = spark.createDataFrame([(i, x, len(x or ""), 1, "q") for i, x in rows], "doc_id long, text string, n_chars long, row int, gone string")
        got = lines.dedup(df, str(tmp_path / str(seed)), min_words=9)
        assert got.columns == df.columns
        found = {x.doc_id: x for x in got.collect()}
        assert len(found) == len(rows)
        for n, text in brute(rows, 9).items():
            assert found[rows[n][0]].text == text
            assert found[rows[n][0]].n_chars == len(text or "")


def test_repeated_rows_and_empty_table(spark, tmp_path):
    text = "\n".join(f"line {k} has five words" for k in range(30))
    df = spark.createDataFrame([(1, text)] * 3, "doc_id long, text string")
    assert sorted(len(r.text) for r in lines.dedup(df, str(tmp_path / "a"), 20).collect()) == [0, 0, len(text)]
    assert lines.dedup(df.limit(0), str(tmp_path / "b")).count() == 0


def test_runs_go_to_their_last_line(spark, tmp_path):
    run = "\n".join(" ".join(f"w{k}" for k in range(n, n + size)) for n, size in ((0, 40), (100, 40), (200, 5)))
    df = spark.createDataFrame([(1, run), (2, "own\n" + run + "\nrest"), (3, run)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(df, str(tmp_path / "run")).collect()}
    assert got == {1: run, 2: "own\nrest", 3: ""}


def test_one_whole_run_stays_of_repeats_within_a_text(spark, tmp_path):
    verses = [" ".join(f"v{k}{n}" for n in range(5)) for k in range(6)]
    texts = {1: "\n".join(["y"] * 100), 2: "\n".join(verses[k % 6] for k in range(40)), 3: "own\n" + "\n".join(["y"] * 60) + "\nend"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(df, str(tmp_path / "r")).collect()}
    assert got == {1: "\n".join(["y"] * 50), 2: "\n".join(verses[k % 6] for k in range(12)), 3: "own\nend"}


def test_given_documents(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id: r.text for r in lines.dedup(df, str(tmp_path / "docs")).collect()} == {rows[n][0]: t for n, t in brute(rows, 50).items()}
