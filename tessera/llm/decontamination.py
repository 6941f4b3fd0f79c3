"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised: lower case, every run of characters other than letters and digits as one blank. An item of n
characters may be found with `errors = floor(rate * n)` edits. It is cut into errors + 1 pieces, of which one must stand
unchanged in any such place; an Aho-Corasick automaton finds all pieces in one pass over a whole text. The pieces are the
leaves of a tree whose nodes have budgets: a node's pieces less one. Where a node is within its budget, one of its two halves
is within its own, so in any place of an item the path from some piece to the root is within budget throughout. Around each
hit the nodes above the piece are verified from the small ones up by Myers' bit-parallel edit distance; most hits end there.

The benchmark is processed in blocks of at most `block_chars` characters, each with its own pass, so that what a task holds
has a fixed bound however many items there are.

Items of fewer than `least_chars` normalised characters are found as whole words only: within the same budget, but from one
word boundary of the text to another.

Defined cases: null texts and items are empty, and empty items are not looked for; repeated items are found each; an empty benchmark or table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP = re.compile(r"[\W_]+")
FOUND_SCHEMA = "doc_id long, item_id long, errors int, item_chars int"


def normalise(text: str | None) -> str:
    """Lower-case words and single blanks."""
    return GAP.sub(" ", (text or "").lower()).strip()


def cut(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal size with their offsets."""
    n, k = len(item), errors + 1
    edges = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Pattern:
    """Myers' automaton of one item: the least edit distance between the item and any part of a text."""

    def __init__(self, item: str) -> None:
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def least(self, text: str, enough: int = -1) -> int:
        """Stops early once the distance is at most `enough`."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, here = full, 0, self.size
        best = here
        for c in text:
            eq = self.masks.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                here += 1
            elif mh & top:
                here -= 1
                if here < best:
                    best = here
                    if best <= enough:
                        return best
            ph = ph << 1 & full  # a match may start anywhere, so nothing is carried in
            plus = mh << 1 & full | (full & ~(xv | ph))
            minus = ph & xv
        return best


def distance(a: str, b: str) -> int:
    """Edit distance of two short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def paths(pieces: int) -> list[list[tuple[int, int]]]:
    """For each piece the nodes above it, as ranges of pieces from the smallest to the one below the root."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(pieces)]
    todo = [(0, pieces)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
            if b - a < pieces:
                for i in range(a, b):
                    out[i].insert(0, (a, b))
    return out


class Matcher:
    """Finds the items of one block in texts, those of fewer than whole_below characters as whole words."""

    held = 50_000  # patterns of nodes kept at once

    def __init__(self, items: list[tuple[int, str]], rate: float, whole_below: int = 0) -> None:
        self.whole_below = whole_below
        self.items = [(i, x, int(rate * len(x)), Pattern(x)) for i, x in items]
        self.paths = {k: paths(k) for k in {errors + 1 for _, _, errors, _ in self.items}}
        self.nodes: dict[tuple[int, int, int], Pattern] = {}
        places: dict[str, list[tuple[int, int, int]]] = {}
        for number, (_, x, errors, _) in enumerate(self.items):
            for k, (offset, piece) in enumerate(cut(x, errors)):
                places.setdefault(piece, []).append((number, k, offset))
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, (len(piece), where))
        if places:
            self.pieces.make_automaton()

    def _likely(self, text: str, number: int, k: int, start: int) -> bool:
        """Whether the nodes above piece k are within their budgets where the item would start at `start`."""
        _, x, errors, _ = self.items[number]
        n, pieces = len(x), errors + 1
        for i, j in self.paths[pieces][k]:
            a, b, most = n * i // pieces, n * j // pieces, j - i - 1
            near = text[max(0, start + a - most) : max(0, start + b + most)]
            if x[a:b] in near:
                continue
            pattern = self.nodes.get((number, i, j))
            if pattern is None:
                if len(self.nodes) >= self.held:
                    self.nodes.clear()
                pattern = self.nodes[number, i, j] = Pattern(x[a:b])
            if pattern.least(near, most) > most:
                return False
        return True

    def _words(self, text: str, x: str, errors: int, start: int) -> int:
        """Least edit distance between x and whole words of text that start and end within `errors` of its place."""
        starts = [a for a in range(max(0, start - errors), start + errors + 1) if text[a : a + 1].strip() and (a == 0 or text[a - 1] == " ")]
        ends = [b for b in range(start + len(x) - errors, min(len(text), start + len(x) + errors) + 1) if text[b : b + 1] in ("", " ")]
        return min((0 if text[a:b] == x else distance(text[a:b], x) for a in starts for b in ends if a < b), default=errors + 1)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, least edit distance, item size) of the items within their error budgets."""
        if not self.items:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        short: dict[int, int] = {}
        for end, (size, where) in self.pieces.iter(text):
            for number, k, offset in where:
                _, x, errors, _ = self.items[number]
                start = end + 1 - size - offset
                if len(x) < self.whole_below:
                    if short.get(number, errors + 1) and self._likely(text, number, k, start):
                        short[number] = min(short.get(number, errors + 1), self._words(text, x, errors, start))
                    continue
                window = (max(0, start - errors), start + len(x) + errors)
                own = spans.get(number)
                if own and own[-1][0] <= window[0] and window[1] <= own[-1][1] or not self._likely(text, number, k, start):
                    continue
                own = spans.setdefault(number, [])
                if own and window[0] <= own[-1][1] and window[0] >= own[-1][0]:
                    own[-1] = (own[-1][0], max(own[-1][1], window[1]))
                else:
                    own.append(window)
        out = [(self.items[number][0], best, len(self.items[number][1])) for number, best in short.items() if best <= self.items[number][2]]
        for number, own in spans.items():
            item, x, errors, pattern = self.items[number]
            exact = text.find(x) if any(b - a >= len(x) for a, b in own) else -1
            best = 0 if exact >= 0 else min(pattern.least(text[a:b], 0) for a, b in own)
            if best <= errors:
                out.append((item, best, len(x)))
        return out


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of at most block_chars characters (or one item)."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        x = normalise(r.t)
        if not x:
            continue
        if rows and size + len(x) > block_chars:
            yield rows
            rows, size = [], 0
        rows.append((r.i, x))
        size += len(x)
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, least_chars: int = 40, block_chars: int = 4_000_000) -> DataFrame:
    """One row for each document row and item found in it: doc_id, item_id, errors, item_chars."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("errors", pa.int32()), ("item_chars", pa.int32())])
    found = None
    for items in blocks(benchmark, block_chars):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate, least_chars)
            for batch in batches:
                rows = [(i, *hit) for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in matcher.find(normalise(x.as_py()))]
                yield pa.RecordBatch.from_pydict({k: [r[n] for r in rows] for n, k in enumerate(schema.names)}, schema=schema)

        one = texts.mapInArrow(run, FOUND_SCHEMA)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], FOUND_SCHEMA) if found is None else found


def flagged(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, least_chars: int = 40, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs with a column `leaks`: how many items the text holds. One pass a block and no shuffle."""
    spark = docs.sparkSession
    out = docs.drop("leaks").withColumn("leaks", F.lit(0))
    schema = T.StructType([*docs.drop("leaks").schema.fields, T.StructField("leaks", T.IntegerType())])
    for items in blocks(benchmark, block_chars):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate, least_chars)
            for batch in batches:
                n = [len(matcher.find(normalise(x.as_py()))) + k.as_py() for x, k in zip(batch.column("text"), batch.column("leaks"), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(n, pa.int32())], schema.names)

        out = out.mapInArrow(run, schema)
    return out
