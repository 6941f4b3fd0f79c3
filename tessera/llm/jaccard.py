"""N-gram Jaccard join: blocked sparse product of documents by word n-grams, with size-derived bounds.

Equal sets are one class; only classes are joined. Counts of n-grams in a fixed number of buckets order all n-grams, rare
buckets first, so that the n-grams of a common passage come last. Two sets of a and b n-grams reach t only with an overlap of
r = ceil(t (a + b) / (1 + t)), and then share SHARED n-grams among the first a - r + SHARED of the one and b - r + SHARED of
the other. A class is therefore indexed under its first n - ceil(t n) + SHARED n-grams; the product adds up the n-grams that
a pair shares within those bounds, and pairs with fewer than SHARED (or than r) are dropped. The rest is verified on whole
sets.

The product has two rounds, at every size. First, each class of a posting list meets one centre, the class where the n-gram
stands nearest to the front (of near copies, that with the fewest n-grams of its own), and what is linked so becomes one
component. Then, in the lists that hold several components, the classes outside a list's most frequent component meet the
others; as components are the result, no pair within a component is made. Components are found by propagating the least
label with pointer jumping, on tables in the shared folder.

N-grams and sets stand by 64-bit hashes: of 10**9 different sets, two are taken for equal with a chance of 3 %.

Defined cases: null texts are empty; an empty set is linked with nothing; shorter texts than n words are one n-gram; rows
are told apart by what they hold, so ids may repeat or be null (a null id counts only if its component has no other); ties
go to the smaller id; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import discard, stored

BUCKET_BITS, CHUNK_BITS = 18, 12
MOST_ID_BITS, BIT_CHUNK = 26, 16
NO_ID = -(2**63)
SHARED = 2  # n-grams that the bounds of a pair must share


class WordHashes(dict):
    """64-bit hashes of words, kept up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of the text's words (A-Z lower-cased)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    if len(h) < n:
        out = np.array([len(h)], np.uint64)
        size, step = 1, len(h)
    else:
        size, step = len(h) - n + 1, n
        out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(step):
            out = (out ^ h[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _class(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63


def bucket_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many sets hold n-grams of each bucket; the size of what is gathered is fixed."""
    size, width = 1 << BUCKET_BITS, 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = WordHashes(), np.zeros(size, np.int64)
        for batch in batches:
            grams = [shingles(t.as_py(), n, known) >> np.uint64(64 - BUCKET_BITS) for t in batch.column(0)]
            total += np.bincount(np.concatenate(grams).astype(np.int64), minlength=size)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(size // width), pa.int32()), "counts": [c.tobytes() for c in total.reshape(-1, width)]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in table.column("counts"))
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": [total.tobytes()]})

    kind = "chunk int, counts binary"
    rows = docs.select("text").mapInArrow(count, kind).groupBy("chunk").applyInArrow(add, kind).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.counts, np.int64)
    return out


def document_sets(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """doc_id, print (of the row), cls (hash of the whole set), n (its size) and its first n-grams in the common order.

    Of the copies of a set in one task, the first alone gets its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64()))])
        for batch in batches:
            out: dict[str, list] = {k: [] for k in schema.names}
            for i, fingerprint, text in zip(batch.column("doc_id").to_pylist(), batch.column("print").to_pylist(), batch.column("text"), strict=True):
                grams = shingles(text.as_py(), n, known)
                size, cls = len(grams), _class(grams)
                first = size - -(-percent * size // 100) + SHARED if size and cls not in seen else 0
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(cls)
                rare = counts[(grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] if first else counts[:0]
                order = np.lexsort((grams[: len(rare)], rare))[:first]
                for k, v in zip(out, (i, fingerprint, cls, size, grams[order].view(np.int64)), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.mapInArrow(run, "doc_id long, print long, cls long, n int, prefix array<long>")


def id_bits(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """A bit array with a bit for the hash of each wanted id, and log2 of its size, of at most 8 MB: it lets through a superset."""
    size = min(MOST_ID_BITS, max(BIT_CHUNK, (16 * wanted.count()).bit_length()))
    width = 1 << BIT_CHUNK
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << size)).cast("int")
    rows = wanted.select((bit / width).cast("int").alias("chunk"), (bit % width).alias("bit")).groupBy("chunk").agg(F.collect_set("bit").alias("bits")).toLocalIterator()
    out = np.zeros((1 << size) // 8, np.uint8)
    for r in rows:
        part = np.zeros(width, bool)
        part[np.array(r.bits, np.int64)] = True
        out[r.chunk * width // 8 : (r.chunk + 1) * width // 8] = np.packbits(part)
    return out, size


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cls and grams (sorted 64-bit hashes) of the wanted classes, each once; wanted: doc_id of a row of each.

    A bit array keeps most other texts from being cut into n-grams and moved; those that pass it are in no pair."""
    bits, size = id_bits(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mine, seen = WordHashes(), np.unpackbits(bits).view(bool), set()
        for batch in batches:
            batch = batch.filter(pa.array(mine[batch.column("bit").to_numpy()], pa.bool_()))
            sets = {}
            for t in batch.column("text"):
                grams = shingles(t.as_py(), n, known)
                if (cls := _class(grams)) not in seen:
                    sets[cls] = grams.tobytes()
            if len(seen) > 300_000:
                seen.clear()
            seen |= sets.keys()
            yield pa.RecordBatch.from_arrays([pa.array(sets.keys(), pa.int64()), pa.array(sets.values(), pa.binary())], ["cls", "grams"])

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << size)).cast("long").alias("bit")
    return docs.select("text", bit).mapInArrow(run, "cls long, grams binary").groupBy("cls").agg(F.first("grams").alias("grams"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cls").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("grams").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame, path: str) -> DataFrame:
    """node and its component's least node, for the nodes of links (a, b)."""
    spark = links.sparkSession
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{path}-edges")
    label = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), f"{path}-0")
    step = 0
    while True:
        near = both.join(label.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("near")).agg(F.min("label").alias("least"))
        moved = label.join(near, F.col("node") == F.col("near")).select("node", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        jump = label.select(F.col("node").alias("via"), F.col("label").alias("on"))
        step += 1
        fresh = stored(moved.join(jump, F.col("label") == F.col("via")).select("node", "was", F.least("label", "on").alias("label")), f"{path}-{step}")
        discard(spark, f"{path}-{step - 1}")
        if fresh.filter("was <> label").limit(1).count() == 0:
            discard(spark, f"{path}-edges")
            return fresh.select("node", "label")
        label = fresh.select("node", "label")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id without nulls, text, a fingerprint of both, and the row itself as d."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("d"))
    return own.withColumn("print", F.xxhash64("doc_id", "text"))


def near_duplicates(docs: DataFrame, path: str, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, print, n_shingles, component_id and group of each row (group: null for empty sets). path: for tables in the shared folder."""
    spark = docs.sparkSession
    texts = _rows(docs).drop("d")
    sets = stored(document_sets(texts, n, percent, bucket_counts(texts, n)), f"{path}/sets")
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    classes = stored(sets.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("row_id"), F.min(real).alias("first")), f"{path}/classes")
    spread = sets.select("cls", "n", F.posexplode("prefix").alias("pos", "token"))
    common = spread.groupBy(F.col("token").alias("t")).agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("t")
    met = stored(spread.join(common, F.col("token") == F.col("t"), "left_semi"), f"{path}/met")
    postings = stored(met.distinct(), f"{path}/postings")
    discard(spark, f"{path}/met")

    def able(x, x_at, y, y_at):
        """Whether sizes x and y and the places of an n-gram in both allow the pair to reach the threshold."""
        most = F.least(x - x_at, y - y_at) + (SHARED - 1)
        return (100 * x >= percent * y) & (100 * y >= percent * x) & ((100 + percent) * most >= percent * (x + y))

    def checked(meetings: DataFrame, name: str, tested: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) of the meetings (a, b, both: sum of their sizes) that reach the threshold, by their whole sets."""
        counted = meetings.groupBy("a", "b").agg(F.count(F.lit(1)).alias("o"), F.first("both").alias("both"))
        pairs = counted.filter((F.col("o") >= SHARED) | ((100 + percent) * F.col("o") >= percent * F.col("both"))).select("a", "b")
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), f"{path}/{name}-pairs")
        ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
        wanted = stored(classes.join(ends, F.col("cls") == F.col("end"), "left_semi").select(F.col("row_id").alias("doc_id")), f"{path}/{name}-wanted")
        found = stored(verify(pairs, stored(whole_sets(texts, wanted, n), f"{path}/{name}-sets"), percent), f"{path}/{name}")
        for part in ("wanted", "sets"):
            discard(spark, f"{path}/{name}-{part}")
        return found

    centre = postings.groupBy(F.col("token").alias("t")).agg(F.min(F.struct("pos", "cls", "n")).alias("c"))
    spokes = postings.join(centre, F.col("token") == F.col("t")).filter((F.col("cls") != F.col("c.cls")) & able(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.pos")))
    near = checked(spokes.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b"), (F.col("n") + F.col("c.n")).alias("both")), "near")
    label = components(near, f"{path}/hot")

    labelled = stored(postings.join(label, F.col("cls") == F.col("node"), "left").select("token", "cls", "n", "pos", F.coalesce("label", "cls").alias("label")), f"{path}/labelled")
    discard(spark, f"{path}/postings")
    parts = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m")).groupBy(F.col("token").alias("t"))
    main = parts.agg(F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("t", F.col("top.label").alias("main"))
    mixed = stored(labelled.join(main, F.col("token") == F.col("t")).select("token", "cls", "n", "pos", "label", (F.col("label") == F.col("main")).alias("in_main")), f"{path}/mixed")
    discard(spark, f"{path}/labelled")
    x = mixed.filter("NOT in_main").select("token", *(F.col(c).alias(f"x_{c}") for c in ("cls", "n", "pos", "label")))
    y = mixed.select("token", *(F.col(c).alias(f"y_{c}") for c in ("cls", "n", "pos", "label", "in_main")))
    once = F.col("y_in_main") | (F.col("x_cls") < F.col("y_cls"))
    meet = x.join(y, (x.token == y.token) & (F.col("x_label") != F.col("y_label")) & once & able(F.col("x_n"), F.col("x_pos"), F.col("y_n"), F.col("y_pos")))
    rest = meet.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b"), (F.col("x_n") + F.col("y_n")).alias("both"))
    links = near.unionByName(checked(rest, "rest", spark.read.schema("a long, b long").parquet(f"{path}/near-pairs")))
    joined = components(links, f"{path}/all")
    for part in ("mixed", "near-pairs", "rest-pairs"):
        discard(spark, f"{path}/{part}")

    named = classes.join(joined, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("label", "cls").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "l")
    by_class = named.join(least, F.col("label") == F.col("l")).select(F.col("cls").alias("c"), "component_id", F.col("label").alias("group"))
    out = sets.drop("prefix").join(by_class, (F.col("cls") == F.col("c")) & (F.col("n") > 0), "left")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "print", "group", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", F.nullif("doc_id", F.lit(NO_ID))).alias("component_id"))


def keep_one(docs: DataFrame, path: str, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but one of each group: that with the smallest id. Rows with empty sets all stay."""
    found = stored(near_duplicates(docs, f"{path}/work", n, percent).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), f"{path}/groups")
    discard(docs.sparkSession, f"{path}/work")
    first = found.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min(F.struct("doc_id", "print")).alias("f")).select("f.doc_id", "f.print")
    free = found.filter(F.col("group").isNull()).select("doc_id", "print").distinct()
    kept = _rows(docs).drop("text").join(first.unionByName(free).withColumn("single", F.lit(True)), ["doc_id", "print"])
    again = first.join(found.groupBy("doc_id", "print").count().filter("count > 1"), ["doc_id", "print"], "left_semi").limit(1).count() > 0
    if again:  # repeated rows of one id and text in a group: one of them stays
        nth = F.row_number().over(Window.partitionBy("doc_id", "print").orderBy(F.lit(0)))
        empty = free.withColumn("empty", F.lit(True))
        kept = kept.withColumn("nth", nth).join(empty, ["doc_id", "print"], "left").filter((F.col("nth") == 1) | F.col("empty"))
    return kept.select("d.*")
