"""Toxicity by a character n-gram linear classifier with naive Bayes log-count ratios.

Features are the character n-grams (4 to 6, with word edges) of all lower-cased words of a text, hashed into 2**BITS buckets;
a bucket's value is the number of its n-grams divided by the number of words, so that a text's score does not drift with its
length. The ratio of each bucket's smoothed document counts in the two classes scales it; a logistic regression over all
scaled buckets gives the weights, of either sign. A text's score is the mean of its words' scores, so that scoring needs one
dictionary look-up a word; unknown words are scored together in flat numpy arrays.

The classifier is fitted in one task on at most `per_class` labelled rows of each class, those with the smallest hash of
the id and text. Everything else covers all rows and whole texts.

Defined cases: null texts are empty texts; an empty text gets the intercept's score; a repeated label row counts once and
conflicting ones count as label 1; repeated document rows of a labelled id are one row if they agree in text, else each has
the label; rows with a null id or label are not learned from; without rows of both classes the score is the share of label 1
among the labels (0 without labels). Columns other than the id, the text and the label are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 18
ORDERS = (4, 5, 6)
FEATURES_AT_ONCE = 1 << 18  # of a step of the fit
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> Counter[str]:
    """Lower-cased words and how often each stands."""
    return Counter(WORD.findall((text or "").lower()))


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and the number of the word that each is in."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer(("\n" + "\n\n".join(words) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(code), np.uint64)
        for k in range(max(ORDERS)):
            n = len(code) - k
            if n <= 0:
                break
            rolled = rolled[:n] * np.uint64(0x9E3779B97F4A7C15) + code[k : k + n] + np.uint64(1)
            if k + 1 in ORDERS:
                inside = word[:n] == word[k : k + n]
                mixed = rolled[inside]
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
                owners.append(word[:n][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def counts_of(words: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how many of its n-grams fall into each."""
    names = list(words)
    bucket, owner = gram_buckets(names)
    times = np.fromiter(words.values(), float, len(names))
    found, place = np.unique(bucket, return_inverse=True)
    return found, np.bincount(place, times[owner], len(found))


def features(words: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their values: n-grams for each 100 words."""
    found, counts = counts_of(words)
    return found, counts * (100 / max(1, words.total()))


def fit(texts: list[str], labels: np.ndarray, prior: float, rounds: int = 120, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """The weights of all buckets and the intercept. prior: share of label 1 among all labelled rows, for a lack of either."""
    if not 0 < labels.sum() < len(labels):
        return np.zeros(0, np.float32), math.log((prior + 1e-6) / (1 - prior + 1e-6))
    seen = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    col, value, ends, scale = array("i"), array("f"), [0], []  # one flat row after another, 8 bytes for each feature
    for x, y in zip(texts, labels, strict=True):
        words = words_of(x)
        g, times = counts_of(words)
        seen[int(y)][g] += 1
        col.frombytes(g.astype(np.int32).tobytes())
        value.frombytes(times.astype(np.float32).tobytes())
        ends.append(len(col))
        scale.append(100 / max(1, words.total()))
    n = [(labels == k).sum() for k in (0, 1)]
    ratio = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    used = np.flatnonzero(seen[0] + seen[1])
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    col, value, ends, scale = np.frombuffer(col, np.int32), np.frombuffer(value, np.float32), np.array(ends), np.array(scale)
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(FEATURES_AT_ONCE, ends[-1], FEATURES_AT_ONCE)), len(texts)]).tolist()
    blocks = [(slice(i, j), slice(ends[i], ends[j]), np.repeat(np.arange(j - i, dtype=np.int32), np.diff(ends[i : j + 1]))) for i, j in itertools.pairwise(cuts)]
    for rows, at, row in blocks:
        value[at] = value[at].astype(float) * scale[rows][row] * ratio[col[at]]
        col[at] = place[col[at]]
    own = np.where(labels == 1, 0.5 / n[1], 0.5 / n[0])  # both classes weigh the same
    weight, bias = np.zeros(len(used)), 0.0
    moment, spread = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, rounds + 1):  # full-batch Adam on the logistic loss with an L2 penalty
        narrow, slope, misses = weight.astype(np.float32), np.zeros(len(used)), np.zeros(len(texts))
        for rows, at, row in blocks:
            where = col[at].astype(np.intp)
            z = np.bincount(row, value[at] * narrow[where], rows.stop - rows.start) + bias
            misses[rows] = miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * own[rows]
            np.add.at(slope, where, (value[at] * miss.astype(np.float32)[row]).astype(float))
        grad = np.r_[slope + penalty * weight, misses.sum()]
        moment = 0.9 * moment + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad * grad
        move = 0.03 * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    out = np.zeros(1 << BITS, np.float32)
    out[used] = weight * ratio[used] * 100
    return out, float(bias)


class Scorer:
    """Scores texts, keeping the scores of the words it has seen, up to `keep_words` of them."""

    def __init__(self, weights: np.ndarray, bias: float, keep_words: int = 300_000) -> None:
        self.weights = weights if len(weights) else np.zeros(1 << BITS)
        self.bias, self.keep_words, self.known = bias, keep_words, {}

    def _learn(self, docs: list[Counter[str]]) -> None:
        if len(self.known) > self.keep_words:
            self.known = {}
        new = list(set().union(*docs).difference(self.known))
        bucket, owner = gram_buckets(new)
        self.known.update(zip(new, np.bincount(owner, self.weights[bucket], len(new)).tolist(), strict=True))

    def __call__(self, texts: list[str | None]) -> list[float]:
        docs = [words_of(x) for x in texts]
        self._learn(docs)
        means = (math.fsum(map(mul, map(self.known.__getitem__, d), d.values())) / max(1, d.total()) + self.bias for d in docs)
        return [1 / (1 + math.exp(-max(-700.0, min(700.0, z)))) for z in means]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 3000) -> tuple[np.ndarray, float]:
    """Fit on at most per_class rows of each class, in one task; the driver gets the weights only."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    share = known.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0] or 0.0
    pick = lambda df, y: df.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    rows = pick(known, 0).unionByName(pick(known, 1))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id").distinct()
    sample = sample.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(2 * per_class)  # repeated ids must not pass the bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(x, y, t) for b in batches for x, y, t in zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True)]
        data.sort()
        weights, bias = fit([t for _, _, t in data], np.array([y for _, y, _ in data], float), share)
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias]})

    row = sample.repartition(1).mapInArrow(run, "weights binary, bias double").first()
    if row is None:
        return np.zeros(0, np.float32), math.log((share + 1e-6) / (1 - share + 1e-6))
    return np.frombuffer(row.weights, np.float32), row.bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], texts_at_once: int = 256) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on) to the rows of docs, whose own columns of these names give way."""
    docs = docs.drop("score", "predicted")
    out = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model)
        for batch in batches:
            text = batch.column("text")
            scores = [s for k in range(0, len(text), texts_at_once) for s in scorer(text.slice(k, texts_at_once).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, out)
