"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The text is cut where no piece of the vocabulary can reach across: before each run of word marks. New words of a batch lie
in one flat numpy array of symbols; each round takes the smallest pair rank of each word by a segmented minimum, merges all
its leftmost occurrences at once, closes the gaps, and drops words without a pair left. A piece that could be part of a
better-ranked piece is merged once a round only, so the result is that of one merge at a time.

Words of more than LONG characters (text without blanks) would take one round for each of their many ranks. They are cut
between characters that stand together in no piece, which no merge can bridge, and what is left longer is merged one pair at a
time from a heap: the same ids in nearly linear time.

Defined cases: null and empty texts have no ids and decode to the empty text; each row is encoded on its own, so repeated
rows repeat their result; other columns than the two named are ignored. Texts are processed whole, in pieces of words.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
NORMAL, BYTE = 1, 6
NONE = np.int32(2**31 - 1)
LONG = 512


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
        yield key >> 3, data[at : at + size]
        at += size


def _flat(words: list[array]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and where each word ends."""
    return np.frombuffer(b"".join(words), np.int32), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))


def _slices(whole: Sequence, ends: np.ndarray) -> list:
    cuts = ends.tolist()
    return [whole[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] if cuts else []


class PieceModel:
    """Tables of a BPE model with identity normalisation, a leading word mark and byte fallback."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        kinds: list[int] = []
        scores: list[float] = []
        for field, value in _fields(model):
            if field == 1:
                entry = dict(_fields(value))
                self.pieces.append(entry[1].decode())
                scores.append(float(np.frombuffer(entry.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(entry.get(3, NORMAL))
        normal = {p: i for i, p in enumerate(self.pieces) if kinds[i] == NORMAL}
        ranked = [i for i in normal.values() if len(self.pieces[i]) > 1]
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("pieces must hold word marks at their start only")
        steps = {s: k for k, s in enumerate(sorted({scores[i] for i in ranked}, reverse=True))}
        self.rank = np.full(len(self.pieces), NONE, np.int32)  # by falling score; pieces may share one
        self.rank[ranked] = [steps[scores[i]] for i in ranked]
        shared = np.bincount(self.rank[ranked]) > 1
        self.bytes_at = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        self.size = len(self.pieces)
        self.digits = [f"{i}," for i in range(self.size)]
        self.shown = ["" if i in self.byte_of else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.digit_size, self.shown_size = (np.fromiter(map(len, x), np.int64, self.size) for x in (self.digits, self.shown))
        self.is_byte = np.array([k == BYTE for k in kinds], bool)
        self.chars = np.arange(0x110000, dtype=np.int32) + self.size  # symbols of characters without a piece
        for p, i in normal.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        keys, merged = [], []
        self.once = np.zeros(self.size, bool)
        for i in ranked:
            p = self.pieces[i]
            self.once[i] |= shared[self.rank[i]]
            for cut in range(1, len(p)):
                left, right = normal.get(p[:cut]), normal.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(i)
                    for part in (left, right):
                        if len(self.pieces[part]) > 1 and self.rank[i] <= self.rank[part]:
                            self.once[part] = True
        self.beside = np.unique([ord(a) << 21 | ord(b) for p in normal for a, b in zip(p, p[1:], strict=False)])
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, NONE without one."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left < self.size) & (right < self.size), self.merged[at], NONE)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        made = self._merge(left, right)
        return np.where(made == NONE, NONE, self.rank[np.minimum(made, self.size - 1)])

    def encode_words(self, words: list[str]) -> list[array]:
        """Ids of words, each of which gets a leading word mark."""
        short = [MARK + w for w in words if len(w) <= LONG]
        if len(short) == len(words):
            return self._rounds(short)
        cut = [self._segments(MARK + w) for w in words if len(w) > LONG]
        done = iter(self._rounds(short + [x for parts in cut for x in parts if len(x) <= LONG + 1]))
        own = [next(done) for _ in short]
        joined = iter([array("i", [i for x in parts for i in (next(done) if len(x) <= LONG + 1 else self._one_by_one(x))]) for parts in cut])
        own = iter(own)
        return [next(own if len(w) <= LONG else joined) for w in words]

    def _segments(self, text: str) -> list[str]:
        """text, cut between characters that no piece holds side by side."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        pair = code[:-1] << 21 | code[1:]
        at = np.searchsorted(self.beside, pair)
        edges = np.flatnonzero(self.beside[np.minimum(at, len(self.beside) - 1)] != pair) + 1 if len(self.beside) else np.arange(1, len(code))
        return [text[a:b] for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(text)], strict=True)]

    def _one_by_one(self, text: str) -> list[int]:
        """Ids of one long stretch: the pair of least rank, leftmost first, until none is left."""
        sym = self.chars[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        heap = [(r, i) for i, r in enumerate(self._ranks(sym[:-1], sym[1:]).tolist()) if r != NONE]
        heapq.heapify(heap)
        sym, end = sym.tolist(), len(text)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        pieces, ranks = dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True)), self.rank.tolist()

        def made(i: int) -> int | None:
            """The piece that symbol i and the next one make."""
            j = after[i] if i >= 0 else end
            return pieces.get(sym[i] * self.size + sym[j]) if j < end and 0 <= sym[i] < self.size > sym[j] else None

        while heap:
            rank, i = heapq.heappop(heap)
            piece = made(i) if sym[i] >= 0 else None
            if piece is None or ranks[piece] != rank:
                continue  # one of the two has changed since
            j = after[i]
            sym[i], sym[j], after[i] = piece, -1, after[j]
            if after[j] < end:
                before[after[j]] = i
            for k in (before[i], i):
                if (piece := made(k)) is not None:
                    heapq.heappush(heap, (ranks[piece], k))
        return [j for i in sym if i >= 0 for j in ([i] if i < self.size else [self.bytes_at[b] for b in chr(i - self.size).encode()])]

    def _rounds(self, words: list[str]) -> list[array]:
        """Ids of words that have their marks, all in flat arrays."""
        if not words:
            return []
        sym = self.chars[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        rank = np.full(len(sym), NONE, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, first), count)
            live = least != NONE
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, least = sym[live], word[live], rank[live], least[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1]  # of adjacent hits (one symbol repeated) every second merges
            run = np.flatnonzero(fresh)
            odd = (hit - np.repeat(hit[run], np.diff(np.r_[run, len(hit)]))) & 1
            hit = hit[odd == 0]
            leading = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            made = self._merge(sym[hit], sym[hit + 1])
            alone = leading | ~self.once[made]
            hit, made = hit[alone], made[alone]
            sym[hit] = made
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            touched = np.zeros(len(sym), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            near = np.flatnonzero(touched)
            rank[near] = NONE
            near = near[near < len(sym) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near] = self._ranks(sym[near], sym[near + 1])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym, ends = sym[order], np.cumsum(np.bincount(word, minlength=len(words)))
        strange = sym >= self.size
        if strange.any():  # characters without a piece become their bytes
            spelt = [[self.bytes_at[b] for b in chr(i - self.size).encode()] for i in sym[strange].tolist()]
            times = np.ones(len(sym), np.int64)
            times[strange] = list(map(len, spelt))
            ends = np.r_[0, np.cumsum(times)][ends]
            sym, strange = np.repeat(sym, times), np.repeat(strange, times)
            sym[strange] = [i for ids in spelt for i in ids]
        return _slices(array("i", sym.astype(np.int32).tobytes()), ends)

    def name_words(self, words: list[array]) -> list[str]:
        """The decimal ids of each word, each with a comma after it."""
        ids, ends = _flat(words)
        return _slices("".join(map(self.digits.__getitem__, ids.tolist())), np.r_[0, np.cumsum(self.digit_size[ids])][ends])

    def decode_words(self, words: list[array]) -> list[str]:
        """Texts of the words' ids, word marks as blanks."""
        ids, ends = _flat(words)
        out = _slices("".join(map(self.shown.__getitem__, ids.tolist())), np.r_[0, np.cumsum(self.shown_size[ids])][ends])
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(self.is_byte[ids]), "right")).tolist():
            out[k] = self.decode_word(words[k])
        return out

    def decode_word(self, ids: Sequence[int]) -> str:
        """Text of ids, word marks as blanks."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.pieces[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    @staticmethod
    def words(text: str) -> list[str]:
        """The text's words without their first word mark."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]


@functools.lru_cache(maxsize=1)
def loaded(model: bytes) -> PieceModel:
    """The tables of a model, built once in each process."""
    return PieceModel(model)


class Codec:
    """Encodes and decodes texts, keeping the words it has seen, up to `keep_words` of them."""

    def __init__(self, model: bytes, keep_words: int = 200_000) -> None:
        self.model, self.keep_words = loaded(model), keep_words
        self.known: dict[str, tuple[array, str, str]] = {}  # ids, their decimals, decoded text

    @property
    def ids(self) -> dict[str, array]:
        """Ids of each word that is known."""
        return {w: own for w, (own, _, _) in self.known.items()}

    def learn(self, docs: list[list[str]]) -> None:
        """Encode the words of some documents that are not known yet."""
        if len(self.known) > self.keep_words:
            self.known = {}
        new = list(set().union(*docs).difference(self.known))
        ids = self.model.encode_words(new)
        self.known.update(zip(new, zip(ids, self.model.name_words(ids), self.model.decode_words(ids), strict=True), strict=True))

    def look_up(self, words: list[str]) -> tuple[Sequence[array], str, str]:
        """Of the words of a document: their ids, all ids in decimals with commas between, the decoded text."""
        ids, named, text = zip(*map(self.known.__getitem__, words), strict=True) if words else ((), (), ())
        return ids, "".join(named)[:-1], "".join(text)[1:]  # without the blank of the leading word mark

    def decode(self, words: list[str]) -> str:
        """The decoded text."""
        return self.look_up(words)[2]


def encode(docs: DataFrame, model: bytes, id_column: str = "doc_id", text_column: str = "text", whole: bool = True, chars_at_once: int = 1_000_000) -> DataFrame:
    """Ids and decoded text of each row: id, n_tokens, ids_sha256, decoded_sha256 and, if whole, ids and decoded."""
    fields = [(id_column, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * whole
    schema = pa.schema(fields)

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
        ids, texts, size = [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= chars_at_once:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for ids, texts in parts(batch):
                split = [codec.model.words(x) for x in texts]
                codec.learn(split)
                out: dict[str, list] = {name: [] for name, _ in fields}
                for i, words in zip(ids, split, strict=True):
                    own, named, decoded = codec.look_up(words)
                    row = [i, sum(map(len, own)), hashlib.sha256(named.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    row += [np.frombuffer(b"".join(own), np.int32), decoded] if whole else []
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    kinds = f"{id_column} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole
    return docs.select(docs[id_column].cast("long").alias(id_column), docs[text_column].cast("string").alias(text_column)).mapInArrow(run, kinds)
