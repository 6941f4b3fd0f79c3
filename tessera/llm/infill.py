"""Fill-in-the-middle: each text is cut at two unit bounds and written as prefix, suffix, middle or suffix, prefix, middle.

Units are maximal runs of the letters A to Z of either case, and every other character alone. A text is stored as its maximal
runs of the two classes with the cumulative number of units; a letter run is one unit, any other run one unit a character. A
cut after k units is found by binary search for the run that holds unit k, and its offset follows from the run's start. Runs
are found slice by slice, so that beside the text itself only its runs and one slice are held.

Defined cases: null texts are empty; an empty text, one that holds a marker, and the share `plain` of all others stay as they
are; a null id is drawn for as an empty one; repeated rows get equal results; an empty table gives an empty result; columns of
docs with the names of the added ones give way, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
SLICE = 1 << 20  # code points whose classes are looked at together


class Runs:
    """Maximal class runs of a text: where each starts, whether it is of letters, and the units up to its end."""

    def __init__(self, text: str) -> None:
        starts, kinds = [], []
        last = None
        for at in range(0, len(text), SLICE):
            code = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = (code | 32) - np.uint32(97) < 26
            begins = np.flatnonzero(np.r_[last is None or letter[0] != last, letter[1:] != letter[:-1]])
            starts.append(begins + at)
            kinds.append(letter[begins])
            last = letter[-1]
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.letters = np.concatenate(kinds) if kinds else np.zeros(0, bool)
        self.ends = np.r_[self.starts[1:], len(text)] if len(self.starts) else self.starts
        self.units = np.cumsum(np.where(self.letters, 1, self.ends - self.starts))

    def __len__(self) -> int:
        """Units of the text."""
        return int(self.units[-1]) if len(self.units) else 0

    def cut(self, k: int) -> int:
        """Code points before the cut after k units."""
        if k == 0:
            return 0
        run = int(np.searchsorted(self.units, k))
        return int(self.ends[run] if self.letters[run] else self.ends[run] - (self.units[run] - k))


def transform(text: str | None, draws: list[int], plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text. draws: two cuts, plain or not, which order."""
    text = text or ""
    runs = Runs(text)
    n = len(runs)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or draws[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted(runs.cut(d % (n + 1)) for d in draws[:2])
    head, middle, tail = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}"


def draws_of(key: Column, seed: int) -> Column:
    """Four numbers below 2**32 from the digest of the seed and a row's key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def infill(docs: DataFrame, key: str = "doc_id", seed: int = 1, plain: int = 10, spm: int = 20, texts_at_once: int = 256) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output. plain: per cent left as they are; spm: per cent of the
    others that begin with the suffix."""
    docs = docs.drop(*ADDED)
    drawn = "draws"
    while drawn in docs.columns:
        drawn += "_"
    out = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in ADDED.items())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), texts_at_once):
                batch = whole.slice(k, texts_at_once)
                made = [transform(x, d, plain, spm) for x, d in zip(batch.column("text").to_pylist(), batch.column(drawn).to_pylist(), strict=True)]
                own = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != drawn]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds))], out.names)

    return docs.withColumn(drawn, draws_of(F.col(key), seed)).mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No marker stands in such a text and none overlaps itself, so the first
    occurrence of each is the one that was written."""
    start = lambda mark: F.instr(output, mark) + F.lit(len(mark))
    between = lambda a, b: F.substr(output, start(a), F.instr(output, b) - start(a))
    middle = F.substr(output, start(MIDDLE))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
