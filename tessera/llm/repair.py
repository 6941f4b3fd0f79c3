"""Conversation structure repair: the cheapest edits that leave an optional system turn and user-assistant pairs.

A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated (no closing mark at
the end). Edits keep a row, give it the role that the structure needs, delete it or insert an empty turn. The states of the
structure and the rows read so far form an acyclic graph of edits; forward and backward minimum costs mark the arcs that lie
on some cheapest way (tight arcs), and from the start on a set of nodes moves along the tight arcs of the least letter.

Rows are put in order by one range sort, whose salt parts a hot conversation or row among tasks, and written with their
places. For the costs a row is one letter (role and fault): letters are gathered by blocks of 4,096 places, and a task that
solves a conversation holds its letters, as long as the audit that it returns, and never its texts. Texts then stream through
the digest behind their conversation's audit, row by row.

Defined cases: null roles and texts are one space, and so is a null in the text that damage is drawn by; rows with a null
conversation id form one conversation with a null id; rows of a conversation stand by turn (null first), role, first 32
characters of the text and its hash; any other role than those with the initials s, u and a fits nowhere and is given another
or deleted; a conversation without rows after damage costs nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import released, stored

SPACE = " \t\n\x0b\x0c\r"
ROLES = "sua"  # initials of system, user, assistant; a fourth kind stands for any other
FULL = {"u": "user", "a": "assistant"}
#: Structure: states and where an initial leads from them; a conversation may end in those of LAST.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
LAST = (0, 3)
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
BLOCK_BITS = 12
FAR = 1 << 60


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults drawn by crc32 of `conv_id:turn`: a row in twenty each is dropped, emptied, loses its
    closing marks, is repeated, or gets the role user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"),
        (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("draw"),
    )
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    return rows.filter("draw <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(0), (F.col("draw") == 3).cast("int")))).drop("col")


def in_order(rows: DataFrame, path: str) -> DataFrame:
    """rows with place, a number that rises along each conversation; written to path."""
    text = lambda c: F.coalesce(c, F.lit(" "))
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), F.monotonically_increasing_id().alias("salt"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 32), F.xxhash64("text"), F.col("salt")]
    with released(rows.sparkSession):
        return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("place", F.monotonically_increasing_id()), path)


def letters(rows: DataFrame) -> DataFrame:
    """conv_id, block and the letters of the block's rows in order, one for each kind of role and fault."""
    first = rows.groupBy("conv_id", "role", F.md5("text").alias("digest")).agg(F.min("place").alias("first")).select("first")
    head = F.substring("role", 1, 1)
    kind = F.when(head == "s", 0).when(head == "u", 1).when(head == "a", 2).otherwise(3)
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    light = rows.select("conv_id", "place", kind.alias("kind"), end.alias("end"))
    fault = F.when(F.col("end") == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    marked = light.join(first, F.col("place") == F.col("first"), "left").select("conv_id", "place", F.char(65 + 4 * F.col("kind") + fault).alias("letter"))
    in_block = F.array_sort(F.collect_list(F.struct("place", "letter")))
    return marked.groupBy("conv_id", F.shiftright("place", BLOCK_BITS).alias("block")).agg(F.array_join(in_block["letter"], "").alias("letters"))


def _moves(kind: int, fault: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row of this kind: letter, cost, state after."""
    out = []
    extra = CUT_OFF if fault == TRUNCATED else 0
    for state, ways in enumerate(NEXT):
        moves = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            if kind < len(ROLES) and ROLES[kind] in ways:
                moves.append(("K", extra, ways[ROLES[kind]]))
            moves += [("R", REROLE + extra, ways[r]) for r in FULL if r in ways]
        out.append(moves)
    return out


MOVES = {chr(65 + 4 * kind + fault): _moves(kind, fault) for kind in range(4) for fault in range(4)}
ADDED = [[("I", INSERT, ways[r]) for r in FULL if r in ways] for ways in NEXT]


def _relaxed(costs: list[int], back: bool) -> list[int]:
    """Costs of the states of one place when turns may be inserted: no cheapest way inserts more often than there are states."""
    for _ in NEXT:
        for state, added in enumerate(ADDED):
            for _, cost, after in added:
                if back:
                    costs[state] = min(costs[state], cost + costs[after])
                else:
                    costs[after] = min(costs[after], cost + costs[state])
    return costs


def solve(row_letters: str) -> tuple[int, str]:
    """Least cost and the least audit of that cost."""
    n, width = len(row_letters), len(NEXT)
    forward, backward = array("q", [FAR]) * ((n + 1) * width), array("q", [FAR]) * ((n + 1) * width)
    costs = _relaxed([0] + [FAR] * (width - 1), False)
    forward[:width] = array("q", costs)
    for i, letter in enumerate(row_letters):
        after = [FAR] * width
        for state, moves in enumerate(MOVES[letter]):
            for _, cost, to in moves:
                after[to] = min(after[to], costs[state] + cost)
        costs = _relaxed(after, False)
        forward[(i + 1) * width : (i + 2) * width] = array("q", costs)
    costs = _relaxed([0 if state in LAST else FAR for state in range(width)], True)
    backward[n * width :] = array("q", costs)
    for i in range(n - 1, -1, -1):
        costs = _relaxed([min(cost + costs[to] for _, cost, to in moves) for moves in MOVES[row_letters[i]]], True)
        backward[i * width : (i + 1) * width] = array("q", costs)
    least, audit, frontier = backward[0], [], {0}  # a node is place * width + state
    while True:
        tight: dict[str, set[int]] = {}
        for node in frontier:
            i, state = divmod(node, width)
            arcs = [(a, c, i * width + to) for a, c, to in ADDED[state]]
            if i < n:
                arcs += [(a, c, (i + 1) * width + to) for a, c, to in MOVES[row_letters[i]][state]]
            for a, c, to in arcs:
                if forward[node] + c + backward[to] == least:
                    tight.setdefault(a, set()).add(to)
        if not tight:
            return least, "".join(audit)
        letter = min(tight)
        audit.append(letter)
        frontier = tight[letter]


def counts(row_letters: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose roles may not follow each other."""
    code = [ord(c) - 65 for c in row_letters]
    heads = [(ROLES + " ")[c // 4] for c in code]
    faults = [c % 4 for c in code]
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), sum(pair not in LEGAL for pair in zip(heads, heads[1:], strict=False))


AUDIT = "conv_id long, audit string, cost long, blank long, duplicate long, truncated long, illegal long"
_AUDIT_TYPES = [pa.int64(), pa.string(), *[pa.int64()] * 5]


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 4096, most_chars: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length and size."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield from batch.slice(k, rows).to_pylist()


def audits(blocks: DataFrame) -> DataFrame:
    """The audit, cost and counts of faults of each conversation."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        short = functools.lru_cache(100_000)(lambda x: (*solve(x)[::-1], *counts(x)))  # most conversations share their few letters
        for conv_id, own in itertools.groupby(_slices(batches), key=lambda row: row["conv_id"]):
            whole = "".join(row["letters"] for row in own)
            yield conv_id, *(short if len(whole) <= 64 else short.__wrapped__)(whole)

    names = [f.split()[0] for f in AUDIT.split(", ")]
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(lambda b: _batches(found(b), names, _AUDIT_TYPES), AUDIT)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, str, str, str]]:
    """Audit rows, followed by the turns that their conversation's edits leave: (None, letter, role, text)."""
    audit, at, state = "", 0, 0

    def added() -> Iterator[tuple[None, str, str, str]]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = next(r for r in FULL if r in NEXT[state])
            state, at = NEXT[state][role], at + 1
            yield None, "I", FULL[role], ""

    for row in _slices(batches):
        if row["place"] < 0:
            yield from added()
            audit, at, state = row["audit"], 0, 0
            yield row, "", "", ""
            continue
        yield from added()
        letter, at = audit[at], at + 1
        if letter != "D":
            role = row["role"][:1] if letter == "K" else next(r for r in FULL if r in NEXT[state])
            state = NEXT[state][role]
            yield None, letter, row["role"] if letter == "K" else FULL[role], row["text"]
    yield from added()


def _behind_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit row and then its rows in order, all in one partition."""
    both = found.withColumn("place", F.lit(-1).cast("long")).unionByName(rows.select("conv_id", "place", "role", "text"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role and text of the turns that stay, are given a role or are inserted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv_id, place = None, 0
        for row, letter, role, text in _replayed(batches):
            if row is not None:
                conv_id, place = row["conv_id"], 0
                continue
            yield conv_id, place, letter, role, text
            place += 1

    names, kinds = ["conv_id", "place", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return _behind_audits(rows, found).mapInArrow(lambda b: _batches(run(b), names, kinds), "conv_id long, place long, edit string, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired_sha256, the digest of the repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own, digest, first = None, hashlib.sha256(), True
        for row, _, role, text in _replayed(batches):
            if row is None:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
                continue
            if own is not None:
                yield *own, digest.hexdigest()
            own, digest, first = [row[n] for n in names[:-1]], hashlib.sha256(), True
        if own is not None:
            yield *own, digest.hexdigest()

    names = [*(f.split()[0] for f in AUDIT.split(", ")), "repaired_sha256"]
    return _behind_audits(rows, found).mapInArrow(lambda b: _batches(run(b), names, [*_AUDIT_TYPES, pa.string()]), AUDIT + ", repaired_sha256 string")


def report(rows: DataFrame, originals: DataFrame, path: str) -> DataFrame:
    """Gaps, faults, cost, audit and digest of every original conversation. path: a new folder that all executors reach."""
    ordered = in_order(rows, path + "/rows")
    found = stored(audits(letters(ordered)), path + "/audits")
    turns = originals.select(F.col("conv_id").cast("long").alias("id"), F.lit(None).cast("long").alias("turn")).unionByName(ordered.select(F.col("conv_id").alias("id"), "turn"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    out = turns.groupBy("id").agg(gaps.alias("gaps")).join(digests(ordered, found), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    whole = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
    return out.drop("conv_id").na.fill(whole).withColumnRenamed("id", "conv_id")
