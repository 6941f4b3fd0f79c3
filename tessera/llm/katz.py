"""Katz backoff language model: Good-Turing discounted bigram counts with exactly normalised backoff weights.

Words are 64-bit hashes; that two words share one is ruled out by odds only (one pair among 10^9 words expects 0.03 of them).
Every context, with all that follows it, belongs to one part, by its hash. Contexts of more than a part's share of the
learned tokens are dealt over all parts by the word that follows; there are at most as many of them as parts.

Tables in the shared folder, each written once: words with their counts; pairs, packed by part, with the words that each
part asks for, until the model stands; the model by part, which holds the pairs' counts, the counts of the words asked for,
and each context's denominator and backoff weight. A token's probability is evaluated recursively: the discounted share of its pair if the pair
is known, else the backoff weight of its context times its probability as a word; an unknown word shares the mass that
discounting leaves, as one type.

Texts are taken in blocks of about `tokens` tokens. A block sends its distinct pairs to each part as one packed row, sorted
and coded against its own words; a part sends back its shares of the block's texts as one packed row, and they are added up.

Discounts follow Katz for counts up to 5; where the counts of counts do not allow that, half a count is taken off. A context
whose pairs are all above 5 gives half a count in its denominator, so that each context's probabilities add up to 1.

Defined cases: null texts are empty and consist of the end token only; repeated rows each count and each get their score; a
null learn flag is no; with nothing to learn from, words are unknown and share all mass; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, released, stored

HIGHEST = 5  # counts above are not discounted
END, START = (xxhash.xxh3_64_intdigest(x) - 2**63 for x in (b" end", b" start"))  # no words: they hold a blank
PAIRS, ASKED, COUNTED, MODEL, SPREAD, TEXT = range(6)  # kinds of rows
ROW = "part int, kind int, w long, c long, x double, y double, data binary"
SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("w", pa.int64()), ("c", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("data", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte values as compressed byte planes, integers in order as differences."""
    forms = [2 if a.dtype.kind == "f" else int((a[1:] >= a[:-1]).all()) for a in arrays]
    planes = [np.array([len(arrays), *map(len, arrays), *forms], np.int64).tobytes()]
    for a, form in zip(arrays, forms, strict=True):
        a = a.view(np.int64) if form == 2 else a.astype(np.int64, copy=False)
        a = np.diff(a, prepend=np.int64(0)) if form == 1 else a
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    """What pack() was given."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)
    out, at = [], head.nbytes
    for size, form in zip(head[1 : n + 1].tolist(), head[n + 1 :].tolist(), strict=True):
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size).T).view(np.int64).reshape(size)
        out.append(a.view(np.float64) if form == 2 else np.cumsum(a) if form == 1 else a)
        at += 8 * size
    return out


def _rows(n: int, **columns: object) -> pa.RecordBatch:
    """n rows of SCHEMA; columns not given are null."""
    full = lambda v, t: pa.array(v, t) if isinstance(v, (np.ndarray, list)) else pa.array([v] * n, t)
    return pa.RecordBatch.from_arrays([full(columns.get(f.name), f.type) for f in SCHEMA], schema=SCHEMA)


class _Block:
    """Tokens of some texts: distinct word hashes in order, and for each token its text, context and word by place."""

    def __init__(self, known: dict[bytes, int], texts: list[np.ndarray], learn: list[bool]) -> None:
        """known: each word's place in order of appearance; texts: the places of their words."""
        flat = np.concatenate(texts)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) - 2**63 for w in known), np.int64, len(known))
        hashes = np.append(hashes, [END, START])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        word = np.full(len(flat) + len(texts), len(known), np.int64)
        inside = np.ones(len(word), bool)
        inside[ends] = False
        word[inside] = flat
        context = np.roll(word, 1)
        context[ends - sizes] = len(known) + 1
        order = np.argsort(hashes)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.hashes, self.word, self.context = hashes[order], place[word], place[context]
        self.text = np.repeat(np.arange(len(texts)), sizes + 1)
        self.learn = np.repeat(np.array(learn, bool), sizes + 1)

    def packed(self, parts: int, spread: np.ndarray, by_text: bool, base: int) -> Iterator[pa.RecordBatch]:
        """One row a part: its distinct pairs with their learned counts, or with their texts and counts in each."""
        of = self.hashes % parts
        part = np.where(np.isin(self.hashes, spread)[self.context], of[self.word], of[self.context])
        size = len(self.hashes)
        key = (part * size + self.context) * size + self.word
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        if by_text:
            text = self.text[order]
            own = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])])  # texts of a pair
            n, text = np.diff(np.append(own, len(key))), text[own]
            start = np.append(np.searchsorted(own, first), len(own))
        else:
            n = np.add.reduceat(self.learn[order].astype(np.int64), first)
        pair = key[first]
        edges = np.searchsorted(pair, np.arange(parts + 1) * size * size)
        ids, rows = np.flatnonzero(np.diff(edges)), []
        for p in ids.tolist():
            a, b = edges[p], edges[p + 1]
            w1, w2 = np.divmod(pair[a:b] - p * size * size, size)
            heads = np.flatnonzero(np.r_[True, w1[1:] != w1[:-1]])
            words, place = np.unique(w2, return_inverse=True)
            arrays = [self.hashes[w1[heads]], np.diff(np.append(heads, b - a)), self.hashes[words], place]
            if by_text:
                s, e = start[a], start[b]
                arrays += [np.diff(start[a : b + 1]), text[s:e], n[s:e], np.array([base])]
            else:
                arrays.append(n[a:b])
            rows.append(pack(*arrays))
        yield _rows(len(ids), part=ids, kind=PAIRS, data=rows)


def _blocks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[_Block, list, list]]:
    """Blocks of texts with their keys and learn flags."""
    known, texts, keys, learn, size = {}, [], [], [], 0
    for batch in batches:
        for key, flag, text in zip(batch.column("key"), batch.column("learn"), batch.column("text"), strict=True):
            words = (text.as_py() or "").encode().lower().split()
            texts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
            keys.append(key.as_py())
            learn.append(bool(flag.as_py()))
            size += len(texts[-1]) + 1
            if size >= tokens:
                yield _Block(known, texts, learn), keys, learn
                known, texts, keys, learn, size = {}, [], [], [], 0
    if texts:
        yield _Block(known, texts, learn), keys, learn


def _split(data: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Context and word hashes of the pairs in a packed row, and what follows them."""
    heads, runs, words, place, *more = unpack(data)
    return np.repeat(heads, runs), words[place], more


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, in order, with the sums of their counts."""
    cut = [_split(x.as_py()) for x in table.column("data")]
    h1, h2, n = (np.concatenate(c) if cut else np.zeros(0, np.int64) for c in zip(*((a, b, m[0]) for a, b, m in cut), strict=True))
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    return h1[first], h2[first], np.add.reduceat(n[order], first)


def discounts(counts: dict[int, int]) -> list[float]:
    """Factors of the counts 1 .. HIGHEST from how many types have each count."""
    n = [counts.get(r, 0) for r in range(HIGHEST + 2)]
    share = (HIGHEST + 1) * n[HIGHEST + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, HIGHEST + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(count: Column, factors: list[float]) -> Column:
    table = F.array(*(F.lit(f) for f in factors))
    return F.when(count <= HIGHEST, count * F.element_at(table, F.least(count, F.lit(HIGHEST)).cast("int"))).otherwise(count.cast("double"))


def _mass(count: np.ndarray, factors: list[float]) -> np.ndarray:
    return count * np.array([0.0, *factors, 1.0])[np.minimum(count, HIGHEST + 1)]


def _weights(total: np.ndarray, kept: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and backoff weights of contexts from the sums over their pairs."""
    den = total + np.where(kept >= total, 0.5, 0.0)
    return den, (1 - kept / den) / (1 - known)


class Model:
    """Learned from the rows of docs (key long, learn boolean, text string) with learn set; scores all of them."""

    def __init__(self, docs: DataFrame, path: str, tokens: int = 1_500_000) -> None:
        self.docs, self.block = docs.select("key", F.coalesce("learn", F.lit(False)).alias("learn"), "text"), tokens
        spark = docs.sparkSession
        self.parts = parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _, _ in _blocks(batches, tokens):
                n = np.bincount(block.word, minlength=len(block.hashes))
                yield pa.RecordBatch.from_arrays([pa.array(block.hashes[n > 0]), pa.array(n[n > 0])], ["w", "c"])

        def keep(df: DataFrame, name: str) -> DataFrame:
            with released(spark):
                return stored(df, f"{path}/{name}")

        counted = self.docs.filter("learn").mapInArrow(count, "w long, c long")
        words = keep(counted.groupBy("w").agg(F.sum("c").alias("c")), "words")
        self.tokens, self.types = (x or 0 for x in words.agg(F.sum("c"), F.count(F.lit(1))).first())
        factors = discounts({r[0]: r[1] for r in words.filter(F.col("c") <= HIGHEST + 1).groupBy("c").count().collect()})
        kept = words.agg(F.sum(_discounted(F.col("c"), factors))).first()[0] or 0.0
        short = 0.5 if kept >= self.tokens and self.tokens else 0.0
        self.word_factors, self.word_den = factors, max(self.tokens, 1) + short
        self.unknown = 1 - kept / self.word_den
        # a word is a context once for each time that it stands; the start stands once a text and is always dealt out
        often = words.filter(F.col("c") * parts > self.tokens).select("w").collect()
        self.spread = spread = np.array([START, *(r.w for r in often if r.w != END)], np.int64)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _, _ in _blocks(batches, tokens):
                yield from block.packed(parts, spread, False, 0)

        def gather(key: tuple, table: pa.Table) -> pa.Table:
            h1, h2, n = _merged(table)
            asked, place = np.unique(h2, return_inverse=True)
            seen = n > 0
            h1, place, n = h1[seen], place[seen], n[seen]
            heads = np.flatnonzero(np.r_[True, h1[1:] != h1[:-1]])[: len(h1)]
            data = pack(h1[heads], np.diff(np.append(heads, len(h1))), asked, place, n)
            few = np.bincount(n[n <= HIGHEST + 1], minlength=HIGHEST + 2)
            part = key[0].as_py()
            return pa.Table.from_batches([
                _rows(1, part=part, kind=PAIRS, data=[data]),
                _rows(len(asked), part=part, kind=ASKED, w=asked),
                _rows(len(few), part=part, kind=COUNTED, w=np.arange(len(few)), c=few),
            ])

        pairs = keep(self.docs.mapInArrow(send, ROW).groupBy("part").applyInArrow(gather, ROW), "pairs")
        counts = pairs.filter(F.col("kind") == COUNTED).groupBy("w").agg(F.sum("c").alias("c")).collect()
        self.pair_factors = discounts({r.w: r.c for r in counts if r.w})
        asked = pairs.filter(F.col("kind") == ASKED).select("part", "w").join(words, "w", "left")
        asked = asked.select("part", F.lit(ASKED).alias("kind"), "w", F.coalesce("c", F.lit(0)).alias("c"), F.lit(None).cast("binary").alias("data"))
        own = pairs.filter(F.col("kind") == PAIRS).select("part", "kind", "w", "c", "data")
        pair_factors, chance = self.pair_factors, self._words()

        def weigh(key: tuple, table: pa.Table) -> pa.Table:
            kind = table.column("kind").to_numpy()
            w, c = (table.column(x).filter(pa.array(kind == ASKED)).to_numpy() for x in ("w", "c"))
            order = np.argsort(w)
            w, c = w[order], c[order]
            heads, runs, _, place, n = unpack(table.column("data").filter(pa.array(kind == PAIRS))[0].as_py())
            starts = np.cumsum(runs) - runs
            sums = [np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (n.astype(float), _mass(n, pair_factors), chance(c[place]))]
            dealt = np.isin(heads, spread)
            with np.errstate(divide="ignore", invalid="ignore"):  # the sums of contexts that are dealt out are not whole
                den, alpha = _weights(*sums)
            part = key[0].as_py()
            return pa.Table.from_batches([
                _rows(1, part=part, kind=MODEL, data=[pack(heads, runs, w, place, n, c, den, alpha)]),
                _rows(int(dealt.sum()), part=part, kind=SPREAD, w=heads[dealt], c=sums[0][dealt].astype(np.int64), x=sums[1][dealt], y=sums[2][dealt]),
            ])

        self.table = keep(own.unionByName(asked).groupBy("part").applyInArrow(weigh, ROW), "model")
        discard(spark, f"{path}/pairs")  # the model holds all of it
        dealt = self.table.filter(F.col("kind") == SPREAD).groupBy("w").agg(F.sum("c").alias("c"), F.sum("x").alias("x"), F.sum("y").alias("y")).orderBy("w").collect()
        total, kept, known = (np.array([r[k] for r in dealt], float) for k in ("c", "x", "y"))
        self.dealt = (np.array([r.w for r in dealt], np.int64), *_weights(total, kept, known))

    def _words(self):
        """A function from counts of words to their probabilities."""
        factors, den, unknown = self.word_factors, self.word_den, self.unknown
        return lambda c: np.where(c > 0, _mass(c, factors) / den, unknown)

    def score(self) -> DataFrame:
        """key, learn, n_tokens, n_known, base_score and score (both log10) of each row of docs."""
        parts, tokens, spread, chance, pair_factors = self.parts, self.block, self.spread, self._words(), self.pair_factors
        base_den, (more, more_den, more_alpha) = self.tokens + 0.5 * (self.types + 1), self.dealt

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base = TaskContext.get().partitionId() << 40
            for block, keys, learn in _blocks(batches, tokens):
                null = np.array([k is None for k in keys])
                told = pack(np.array([k or 0 for k in keys], np.int64), null.astype(np.int64), np.array(learn, np.int64))
                yield _rows(1, part=base % parts, kind=TEXT, w=base, data=[told])
                yield from block.packed(parts, spread, True, base)
                base += len(keys)

        def add(key: tuple, table: pa.Table) -> pa.Table:
            kind = table.column("kind").to_numpy()
            texts = table.filter(pa.array(kind == TEXT))
            blocks, rows = texts.column("w").to_pylist(), texts.column("data").to_pylist()
            kinds = [TEXT] * len(rows)
            model = table.column("data").filter(pa.array(kind == MODEL))
            if not len(model):
                return pa.Table.from_batches([_rows(len(rows), kind=kinds, w=blocks, data=rows)])
            heads, runs, words, place, r, c, den, alpha = unpack(model[0].as_py())
            pair = np.repeat(np.arange(len(heads)), runs) * len(words) + place
            mass, base = _mass(r, pair_factors), np.log10((c + 0.5) / base_den)
            p = chance(c)
            for data in table.column("data").filter(pa.array(kind == PAIRS)):
                own, size, asked, at, several, text, m, first = unpack(data.as_py())
                w = np.searchsorted(words, asked)[at]
                h = np.searchsorted(heads, own)
                there = np.zeros(len(own), bool) if not len(heads) else heads[np.minimum(h, len(heads) - 1)] == own
                h = np.where(there, h, 0)
                own_den, own_alpha = (den[h], np.where(there, alpha[h], 1.0)) if len(heads) else (np.ones(len(own)), np.ones(len(own)))
                if len(more):
                    k = np.minimum(np.searchsorted(more, own), len(more) - 1)
                    own_den, own_alpha = (np.where(more[k] == own, a[k], b) for a, b in ((more_den, own_den), (more_alpha, own_alpha)))
                h, there, own_den, own_alpha = (np.repeat(x, size) for x in (h, there, own_den, own_alpha))
                wanted = h * len(words) + w
                k = np.minimum(np.searchsorted(pair, wanted), max(len(pair) - 1, 0))
                seen = there & (pair[k] == wanted) if len(pair) else there
                share = np.where(seen, mass[k] / own_den, 0.0) if len(pair) else np.zeros(len(w))
                score = np.log10(np.where(seen, share, own_alpha * p[w]))
                n_of = lambda x: np.bincount(text, np.repeat(x, several) * m)  # noqa: B023, E731
                count = np.bincount(text, m)
                ids = np.flatnonzero(count)
                blocks.append(int(first[0]))
                kinds.append(PAIRS)
                rows.append(pack(ids, count[ids].astype(np.int64), n_of(c[w] > 0)[ids].astype(np.int64), n_of(base[w])[ids], n_of(score)[ids]))
            return pa.Table.from_batches([_rows(len(rows), kind=kinds, w=blocks, data=rows)])

        def total(key: tuple, table: pa.Table) -> pa.Table:
            kind = table.column("kind").to_numpy()
            keys, null, learn = unpack(table.column("data").filter(pa.array(kind == TEXT))[0].as_py())
            sums = [np.zeros(len(keys), t) for t in (np.int64, np.int64, float, float)]
            for data in table.column("data").filter(pa.array(kind == PAIRS)):
                ids, *shares = unpack(data.as_py())
                for whole, share in zip(sums, shares, strict=True):
                    whole[ids] += share
            names = ["key", "learn", "n_tokens", "n_known", "base_score", "score"]
            return pa.table([pa.array(keys, mask=null > 0), pa.array(learn > 0), *map(pa.array, sums)], names)

        sent = self.docs.mapInArrow(send, ROW).unionByName(self.table.filter(F.col("kind") == MODEL))
        shares = sent.groupBy("part").applyInArrow(add, ROW)
        return shares.groupBy("w").applyInArrow(total, "key long, learn boolean, n_tokens long, n_known long, base_score double, score double")
