"""Similarity of names by matching blocks, and of function signatures by name, parameters, texts and decorators.

The ratio is twice the characters in matching blocks over all characters; blocks are the longest common stretch and, left and
right of it, again. It is computed by the standard library, in batches, for pairs that no cheaper bound rules out: the matching
characters are at most those that two names have in common in any order, and at most a longest common subsequence of them."""

from __future__ import annotations

import bisect
import json
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words that do not count in texts, and parameters that do not count in signatures.
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "be", "been", "and", "or", "to", "of", "in", "for")
OWN = ("self", "cls")
BLOCK, CHUNK, AT_ONCE = 4096, 1 << 18, 4096  # functions asked for, and others, that meet in one task, and those that are compared at once
NAMES, OTHERS, CELLS = 16384, 1024, 1 << 22  # names, and others, that meet in one task, and characters and counts of names that are held at once
DIGITS = str.maketrans("123456789", "000000000")


def letters(name: Column) -> Column:
    """The characters of a name, each with how many equal ones come before it, so that common ones can be counted as a set."""
    chars = F.array_sort(F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0)))
    return F.transform(chars, lambda c, i: F.concat(c, (i + 1 - F.array_position(chars, c)).cast("string")))


def most_ratio(a: Column, b: Column) -> Column:
    """Upper bound of the ratio of two names from their letters; 1 for two empty names."""
    whole = F.size(a) + F.size(b)
    return F.when(whole > 0, 2.0 * F.size(F.array_intersect(a, b)) / whole).otherwise(F.lit(1.0))


def with_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with ratio, the share of matching blocks of column a with column b; null names are empty."""
    out = T.StructType([*pairs.schema.fields, T.StructField("ratio", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = SequenceMatcher(None)
        for batch in batches:
            ratios = []
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                matcher.set_seqs(x or "", y or "")
                ratios.append(matcher.ratio())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratios, pa.float64())], out.names)

    return pairs.mapInArrow(run, out)


def _spelt(names: list[str], codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The code of each character by place and name, and how often a name has each code; characters without a code count as one more."""
    n, none = len(names), len(codes)
    length = np.fromiter(map(len, names), np.int64, n)
    flat, back = np.unique(np.frombuffer("".join(names).encode("utf-32-le"), np.uint32), return_inverse=True)
    code = np.fromiter((codes.get(chr(c), none) for c in flat.tolist()), np.int32, len(flat))[back]
    row, place = np.repeat(np.arange(n), length), np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    at = np.full((int(length.max()), n), none, np.int32)
    at[place, row] = code
    return at, np.bincount(code.astype(np.int64) * n + row, minlength=(none + 1) * n).reshape(none + 1, n).astype(np.int32)


def _common(at: np.ndarray, name: str, codes: dict[str, int]) -> np.ndarray:
    """The length of a longest common subsequence of a name of up to 63 characters and each that `at` spells, a bit for each place."""
    mask = np.zeros(len(codes) + 1, np.uint64)
    for i, c in enumerate(name):
        if c in codes:
            mask[codes[c]] |= np.uint64(1 << i)
    free = np.full(at.shape[1], (1 << 64) - 1, np.uint64)
    for row in at:
        hit = free & mask[row]
        free = (free + hit) | (free - hit)
    return np.bitwise_count(~free & np.uint64((1 << len(name)) - 1))


def _likely(left: list[str], right: list[str], least: float) -> Iterator[tuple[list[str], str]]:
    """The names of left that no bound rules out for each of right: in length, in letters of any order, in letters of one order.
    Names of one length lie together, so that long ones take room from no others."""
    left = sorted(left, key=len)
    codes = {c: i for i, c in enumerate(sorted(set().union(*right)))}
    begin = 0
    while begin < len(left):
        end = begin
        while end < len(left) and (end == begin or (len(left[end]) + len(codes) + 1) * (end + 1 - begin) <= CELLS):
            end += 1
        names, begin = left[begin:end], end
        at, times = _spelt(names, codes)
        length = np.fromiter(map(len, names), np.int64, len(names))
        for name in right:
            n = len(name)
            ratio = lambda shared, own, n=n: 2.0 * shared / (own + n)
            fits = np.flatnonzero(ratio(np.minimum(length, n), length) > least)
            if not len(fits):
                continue
            low, high = int(fits[0]), int(fits[-1]) + 1
            shared = sum(np.minimum(times[codes[c], low:high], m) for c, m in Counter(name).items())
            found = low + np.flatnonzero(ratio(shared, length[low:high]) > least)
            if n < 64 and len(found):
                found = found[ratio(_common(at[: length[found].max(), found], name, codes), length[found]) > least]
            if len(found):
                yield [names[i] for i in found.tolist()], name


def close_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left, right, ratio: names (column name) whose ratio is above `least` (0 up to 1), each distinct pair once.

    Blocks of the left names meet chunks of the right ones in one task each, which hands on the pairs that no bound rules out, so
    that no other pair is a row. Null and empty names have no partner."""
    distinct = lambda df: df.select("name").filter("name <> ''").distinct()
    n_blocks, n_chunks = max(left.sparkSession.sparkContext.defaultParallelism, left.count() // NAMES), max(1, right.count() // OTHERS)
    part_of = lambda n: F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = distinct(left).withColumn("block", part_of(n_blocks)).withColumn("chunk", every(n_chunks))
    b = distinct(right).withColumn("chunk", part_of(n_chunks)).withColumn("block", every(n_blocks))

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        x, y = (t.column("name").to_pylist() for t in (mine, others))
        found = list(_likely(x, y, least)) if x and y else []
        return pa.table([pa.array([n for names, _ in found for n in names], pa.string()), pa.array([n for names, n in found for _ in names], pa.string())], names=["left", "right"])

    met = a.groupBy("block", "chunk").cogroup(b.groupBy("block", "chunk")).applyInArrow(run, "left string, right string")
    return with_ratio(met, "left", "right").filter(F.col("ratio") > least)


def parts(name: Column) -> Column:
    """Lower-case parts of a name, at underscores or else at capitals (F1)."""
    camel = F.transform(F.regexp_extract_all(name, F.lit("[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(F.when(F.contains(name, F.lit("_")), F.split(F.lower(name), "_")).otherwise(camel), lambda x: x != ""))


def words(text: Column) -> Column:
    """Distinct lower-case words of a text but for the stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_except(found, F.array(*(F.lit(w) for w in STOP_WORDS)))


def parameter_names(parameters: Column) -> Column:
    """Names of parameters without annotations, and without the object's own."""
    names = F.transform(parameters, lambda p: F.trim(F.split_part(p, F.lit(":"), F.lit(1))))
    return F.array_except(F.coalesce(names, F.array().cast("array<string>")), F.array(*(F.lit(x) for x in OWN)))


SETS = {"parts": (0.3, 0.5), "names": (0.2, 0.3), "words": (0.2, 0.3), "marks": (0.2, 0.5)}  # weight of a set, and what it must be above


class _Others:
    """Functions by kind of name: the letters of names in any order, with all digits as one letter. Functions whose other sets are
    equal are of one class, and what does not depend on names is counted once for each class."""

    def __init__(self, table: pa.Table) -> None:
        kinds: dict[str, int] = {}
        spelt = [x.translate(DIGITS) for x in table.column("low").to_pylist()]
        same = {x: kinds.setdefault("".join(sorted(x)), len(kinds)) for x in dict.fromkeys(spelt)}
        kind = np.fromiter((same[x] for x in spelt), np.int64, len(spelt))
        order = np.argsort(kind, kind="stable")
        table = table.take(pa.array(order))
        self.first = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
        self.paths, self.names, self.lines, self.lows = (table.column(c).to_pylist() for c in ("path", "name", "line", "low"))
        self.kind, self.kind_length = kind[order], np.fromiter(map(len, kinds), np.int64, len(kinds))
        self.length = self.kind_length[self.kind]
        self.times = {c: np.zeros(len(kinds), np.int32) for c in set().union(*kinds)}
        for i, x in enumerate(kinds):
            for c, m in Counter(x).items():
                self.times[c][i] = m
        parts = table.column("parts").to_pylist()
        self.with_part = {x: np.array(at) for x, at in _holders([[(x, len(xs)) for x in xs] for xs in parts]).items()}
        self.n_parts = sorted(set(map(len, parts)))
        sets = table.column("sets").combine_chunks().dictionary_encode()
        classes = [json.loads(x) for x in sets.dictionary.to_pylist()]
        self.of = sets.indices.to_numpy()
        self.sizes = {c: np.fromiter((len(x[c]) for x in classes), np.int64, len(classes)) for c in ("names", "words", "marks")}
        self.held = {c: {x: np.array(at) for x, at in _holders([x[c] for x in classes]).items()} for c in self.sizes}
        self.codes = {c: i for i, c in enumerate(sorted(set().union(*self.lows)))}
        short = [x if len(x) < 64 else "" for x in self.lows]
        self.at = _spelt(short, self.codes)[0] if any(short) else np.zeros((0, len(short)), np.int32)

    def by_class(self, mine: dict) -> dict[str, np.ndarray]:
        """What the sets but the parts of names add to the score, by class."""
        by = {}
        for c, size in self.sizes.items():
            weight, above = SETS[c]
            common = np.zeros(len(size), np.int64)
            for x in mine[c]:
                if x in self.held[c]:
                    common[self.held[c][x]] += 1
            alike = common / np.maximum(size + len(mine[c]) - common, 1)
            by[c] = np.where(alike > above, alike * weight, 0.0)
        return by

    def by_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions, and what the parts of names add to the score there, where they add anything. As many parts must be shared then
        that, for others of so many parts, not all of the rarest of these can be missing."""
        weight, above = SETS["parts"]
        found, added = [np.zeros(0, np.int64)], [np.zeros(0)]
        for n in self.n_parts:
            least = next((c for c in range(1, min(n, len(parts)) + 1) if c / (n + len(parts) - c) > above), n + 1)
            lists = sorted((self.with_part.get((x, n), found[0]) for x in parts), key=len)
            if least > n or not (met := [x for x in lists[: max(0, len(parts) - least + 1)] if len(x)]):
                continue
            at = np.unique(np.concatenate(met))
            common = np.sum([x[np.minimum(np.searchsorted(x, at), len(x) - 1)] == at for x in lists if len(x)], axis=0)
            alike = common / np.maximum(n + len(parts) - common, 1)
            found.append(at[alike > above])
            added.append(alike[alike > above] * weight)
        return np.concatenate(found), np.concatenate(added)

    def most_by_name(self, low: str) -> np.ndarray:
        """Upper bound of the ratio of names, by kind of name."""
        shared = sum((np.minimum(self.times[c], m) for c, m in Counter(low.translate(DIGITS)).items() if c in self.times), np.zeros(len(self.kind_length), np.int64))
        whole = self.kind_length + len(low)
        return np.where(whole > 0, 2.0 * shared / np.maximum(whole, 1), 1.0)

    def most_in_order(self, low: str, found: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The bound of those found by a longest common subsequence, where both names are of fewer than 64 characters."""
        if not 0 < len(low) < 64:
            return most
        shared = _common(self.at[: min(int(self.length[found].max()), len(self.at))][:, found], low, self.codes)
        return np.where(self.length[found] < 64, 2.0 * shared / (self.length[found] + len(low)), most)


def _best_of(own: pa.Table, others: pa.Table, k: int, least: float) -> Iterator[tuple[int, tuple, float]]:
    """Row of own, path, name and line of another and score of the k best others of each, the first by path, name and line of equal ones.

    Those whose names have parts in common come first, then the kinds of names from the highest bound down, some thousand functions
    at a time, until no bound reaches the k best."""
    them = _Others(others)
    seen = np.zeros(len(others), bool)
    last, by, rest = None, {}, np.zeros(0)
    for i, mine in sorted(enumerate(own.to_pylist()), key=lambda x: x[1]["sets"]):
        if mine["sets"] != last:
            last, by = mine["sets"], them.by_class(json.loads(mine["sets"]))
            rest = by["names"] + by["words"] + by["marks"]
        best: list[tuple] = []
        most = them.most_by_name(mine["low"])
        order = np.argsort(-most, kind="stable")
        most_of_kind = _highest(most[order], float(rest.max()))
        at, parted = them.by_parts(mine["parts"])
        _consider(mine, them, by, rest, most, at, parted, k, least, best)
        seen[at] = True
        ends = np.cumsum(them.first[order + 1] - them.first[order])
        begin, at_once = 0, 512
        while begin < len(order) and most_of_kind[begin] >= min(_floor(best, k, least), 1.0):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + at_once, "right")))
            kinds = order[begin:end]
            many = them.first[kinds + 1] - them.first[kinds]
            found = np.arange(int(many.sum())) + np.repeat(them.first[kinds] - np.cumsum(many) + many, many)
            found = found[~seen[found]]
            _consider(mine, them, by, rest, most, found, np.zeros(len(found)), k, least, best)
            begin, at_once = end, AT_ONCE
        seen[at] = False
        yield from ((i, (path, name, line), -score) for score, path, name, line, _ in best)


def _floor(best: list[tuple], k: int, least: float) -> float:
    return -best[-1][0] if len(best) == k else least


def _highest(most: np.ndarray, rest: np.ndarray | float) -> np.ndarray:
    """Upper bound of a score from that of the ratio of names and what else adds to it."""
    return np.minimum(np.where(most > 0.3, most * 0.4, 0.0) + rest + 1e-9, 1.0)


def _consider(mine: dict, them: _Others, by: dict, rest: np.ndarray, most: np.ndarray, found: np.ndarray, parted: np.ndarray, k: int, least: float, best: list[tuple]) -> None:
    """Put those of found into the k best that belong there; parted is what the parts of their names add to the score."""
    shared = most[them.kind[found]]
    for ordered in (False, True):
        if ordered and len(found):
            shared = them.most_in_order(mine["low"], found, shared)
        highest = _highest(shared, rest[them.of[found]] + parted)
        likely = np.flatnonzero(highest >= min(_floor(best, k, least), 1.0))
        found, parted, shared, highest = found[likely], parted[likely], shared[likely], highest[likely]
    matcher, ratios = SequenceMatcher(None), {}
    for x in np.argsort(-highest, kind="stable").tolist():
        if len(best) == k and highest[x] < -best[-1][0]:
            break
        j = int(found[x])
        if them.paths[j] == mine["path"] and them.names[j] == mine["name"]:
            continue
        if (low := them.lows[j]) not in ratios:
            matcher.set_seqs(mine["low"], low)
            ratios[low] = matcher.ratio()
        ratio, of = ratios[low], them.of[j]
        score = min((ratio * 0.4 if ratio > 0.3 else 0.0) + float(parted[x]) + float(by["names"][of]) + float(by["words"][of]) + float(by["marks"][of]), 1.0)
        if score >= least and score > 0:
            bisect.insort(best, (-score, them.paths[j], them.names[j], them.lines[j], j))
            del best[k:]


def _holders(lists: list[list]) -> dict:
    """The positions of the lists that hold each element."""
    out: dict = {}
    for i, xs in enumerate(lists):
        for x in xs:
            out.setdefault(x, []).append(i)
    return out


def neighbours(asked: DataFrame, functions: DataFrame, k: int = 10, least: float = 0.3) -> DataFrame:
    """path, name, rank, other_path, other_name, score: for each function asked for, the k others that are most alike, from a score
    of `least` on (J11, F7). Both have path, name, line, parameters, docstring, decorators.

    Blocks of the functions asked for meet chunks of all functions in one task each, which hands on the k best of the chunk. The sets
    of a function but the parts of its name go there as one text, as many functions share them."""
    sets = F.to_json(F.struct(parameter_names(F.col("parameters")).alias("names"), words(F.col("docstring")).alias("words"), F.array_distinct(F.coalesce("decorators", F.array().cast("array<string>"))).alias("marks")))
    rows = lambda df: df.filter("name IS NOT NULL AND path IS NOT NULL").select(*(F.col(c).alias(c) for c in ("path", "name", "line")), F.lower("name").alias("low"), parts(F.col("name")).alias("parts"), sets.alias("sets"))
    n_chunks = max(1, functions.count() // CHUNK)
    n_blocks = max(1, 2 * functions.sparkSession.sparkContext.defaultParallelism // n_chunks, asked.count() // BLOCK)
    part_of = lambda n: F.pmod(F.xxhash64("path", "name", "line"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows(asked).withColumn("block", part_of(n_blocks)).withColumn("chunk", every(n_chunks))
    others = rows(functions).withColumn("chunk", part_of(n_chunks)).withColumn("block", every(n_blocks))
    out = T.StructType([*(T.StructField(c, T.StringType()) for c in ("path", "name")), T.StructField("line", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("other_path", "other_name")), T.StructField("other_line", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def run(mine: pa.Table, all_: pa.Table) -> pa.Table:
        found = list(_best_of(mine, all_, k, least)) if len(mine) and len(all_) else []
        x, y, score = zip(*found, strict=True) if found else ((), (), ())
        left = mine.select(["path", "name", "line"]).take(pa.array(x, pa.int64()))
        right = [pa.array(c, kind) for c, kind in zip(zip(*y, strict=True) if y else ((), (), ()), (pa.string(), pa.string(), pa.int32()), strict=True)]
        return pa.table([*left.columns, *right, pa.array(score, pa.float64())], names=out.names)

    met = own.groupBy("block", "chunk").cogroup(others.groupBy("block", "chunk")).applyInArrow(run, out)
    rank = F.row_number().over(Window.partitionBy("path", "name", "line").orderBy(F.desc("score"), "other_path", "other_name", "other_line"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("path", "name", "rank", "other_path", "other_name", "score")


def typo_kind(name: Column, popular: Column) -> Column:
    """How a name departs from a popular one of a similar spelling."""
    n, p = F.length(name), F.length(popular)
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    differ = F.filter(F.arrays_zip(chars(name).alias("a"), chars(popular).alias("b"), F.sequence(F.lit(1), F.greatest(n, F.lit(1))).alias("i")), lambda x: x["a"] != x["b"])
    first, second = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    confused = F.exists(differ, lambda x: F.concat(x["a"], x["b"]).isin(*CONFUSED))
    swapped = (F.size(differ) == 2) & (second["i"] == first["i"] + 1) & (first["a"] == second["b"]) & (second["a"] == first["b"])
    return (
        F.when((n == p) & confused, "visual_similarity").when((n == p) & (F.size(differ) == 1), "character_swap").when(n == p - 1, "missing_char").when(n == p + 1, "extra_char")
        .when((n == p) & swapped, "transposition").otherwise("other")
    )


#: Pairs of characters that look alike, in both orders.
CONFUSED = ("l1", "li", "lI", "1l", "1i", "1I", "0O", "0o", "i1", "il", "I1", "Il", "O0", "o0")


def typosquats(names: DataFrame, popular: DataFrame) -> DataFrame:
    """name, popular, ratio, kind and risk of names (column name) that are spelt almost like a popular one: of several, the one of
    the highest ratio, then the first by name (J12)."""
    close = close_names(names, popular, 0.7).filter("ratio < 1")
    best = close.groupBy("left").agg(F.min(F.struct((-F.col("ratio")).alias("order"), "right", "ratio")).alias("best"))
    best = best.select(F.col("left").alias("name"), F.col("best.right").alias("popular"), "best.ratio").withColumn("kind", typo_kind(F.col("name"), F.col("popular")))
    ratio, sly = F.col("ratio"), F.col("kind").isin("character_swap", "missing_char", "transposition")
    risk = F.when((ratio > 0.9) & (F.col("kind") == "visual_similarity"), "CRITICAL").when((ratio > 0.85) & sly, "HIGH").when(ratio > 0.8, "MEDIUM").otherwise("LOW")
    return best.withColumn("risk", risk)
