"""Exact top-k by integer inner product over a pivot-distance index.

Vectors become integers floor(scale * component). Adding one coordinate that brings all to one norm turns the largest inner
product into the least Euclidean distance, for which the triangle inequality holds. A vector's key is its nearest pivot and
the distance to it; vectors sorted by key are dealt into index parts of about `part_rows`. First, each query searches the
part where its own key falls, annuli outwards, and so gets a lower bound for its k-th score. The annuli of all parts (at most
MOST_PARTS parts, so that this table has a bound) then tell which parts the triangle inequality leaves for each query; only
those meet. Queries whose own parts lie side by side form a tile of about `tile_queries`, and a part is sent to the tiles that
need it; a tile expands a part's annuli sorted by their bound and stops where the triangle inequality rules out the rest. The
final scores are exact integers.

Pivots are the `pivots` vectors with the smallest hash (a bounded sample that affects speed only).

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do null ids; a repeated id is a
row of its own but never a candidate of the query with its id; shorter vectors count as filled with zeros; ties go to the
smaller id; fewer than k candidates are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import stored

MOST_PARTS = 1 << 16
SLACK = 1e-6  # relative; distances are floating-point numbers


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and x, the integer components."""
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length, short ones filled with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(ends), dim), np.int64)
    out[np.arange(dim) < ends[:, None]] = flat
    return out


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    """One coordinate more, so that all have this norm."""
    x = x.astype(float)
    return np.c_[x, np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every partial sum fits its 53 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ x.astype(float).T).astype(np.int64) if most < 2.0**53 else q @ x.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: by falling score, then by id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def highest_scores(q: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray, pivots: np.ndarray, norm: float) -> np.ndarray:
    """For each query and annulus (cell, least and greatest key) a score that no row of the annulus passes."""
    x = _query_lift(q)
    size2 = (x * x).sum(1)
    to_pivot = np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], 1) if len(pivots) else np.zeros((len(q), 0))
    apart = np.maximum(np.maximum(low[None] - to_pivot[:, cell], to_pivot[:, cell] - high[None]), 0)  # least distance
    bound = (size2[:, None] + norm * norm - apart**2) / 2
    return bound + SLACK * (np.abs(bound) + norm * norm + size2[:, None]) + 1


def search_part(ids: np.ndarray, x: np.ndarray, keys: np.ndarray, cells: np.ndarray, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray | None, pivots: np.ndarray, norm: float, k: int, annulus: int = 512) -> Iterator[tuple[int, int, int]]:
    """(query id, id, score) of the k best of one part for each query, none below its floor.

    ids, x, keys and cells of the part stand by cell and key; floor: scores that are known to be reached."""
    edges = [0]
    while edges[-1] < len(ids):  # annuli: rows of one cell, at most so many
        stop = min(edges[-1] + annulus, len(ids))
        edges.append(int(min(stop, np.searchsorted(cells, cells[edges[-1]], "right"))))
    rings = [(a, b, int(cells[a]), keys[a], keys[b - 1]) for a, b in zip(edges, edges[1:], strict=False)]
    bound = highest_scores(q, np.array([r[2] for r in rings]), np.array([r[3] for r in rings]), np.array([r[4] for r in rings]), pivots, norm)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    reached = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
    for ring in np.argsort(-bound.max(0), kind="stable"):
        live = np.flatnonzero(bound[:, ring] >= reached)
        if not len(live):
            continue
        a, b, *_ = rings[ring]
        scores = _products(q[live], x[a:b])
        for i, row in zip(live, scores, strict=True):
            take = (ids[a:b] != q_ids[i]) & (row >= reached[i])
            if not take.any():
                continue
            s, d = np.r_[best[i][0], row[take]], np.r_[best[i][1], ids[a:b][take]]
            kept = _best(s, d, k)
            best[i] = s[kept], d[kept]
            if len(kept) == k:
                reached[i] = max(reached[i], float(best[i][0][-1]))
    for i, (s, d) in enumerate(best):
        for score, found in zip(s.tolist(), d.tolist(), strict=True):
            yield int(q_ids[i]), found, score


def _query_lift(q: np.ndarray) -> np.ndarray:
    return np.c_[q.astype(float), np.zeros(len(q))]


def top_k(vectors: DataFrame, path: str, every: int = 100, k: int = 10, scale: int = 1024, pivots: int = 64, part_rows: int = 8192, tile_queries: int = 2048) -> DataFrame:
    """The k best candidates of each query (ids divisible by `every`): query_id, rank, vec_id, score. path: for the index."""
    spark = vectors.sparkSession
    base = usable(vectors, scale)
    shape = base.agg(F.max(F.size("x")), F.sqrt(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c))), F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    dim, norm, rows, asked = shape[0] or 1, (shape[1] or 0.0) * (1 + 1e-9) + 1e-9, shape[2], shape[3]
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    points = np.zeros((len(sample), dim))
    for n, r in enumerate(sample):
        points[n, : len(r.x)] = r.x
    points = _lift(points, norm)
    parts, tiles = max(1, min(MOST_PARTS, -(-rows // part_rows))), max(1, -(-asked // tile_queries))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lift(_matrix(batch.column("x"), dim), norm)
            far = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * x @ points.T, 0))
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.linalg.norm(x - points[cell], axis=1))], [*batch.schema.names, "cell", "key"])

    keyed = base.mapInArrow(key, "vec_id long, x array<long>, cell int, key double")
    dealt = keyed.repartitionByRange(parts, "cell", "key", "vec_id").sortWithinPartitions("cell", "key", "vec_id").withColumn("part", F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(path)
    index, again = (spark.read.schema("vec_id long, x array<long>, cell int, key double, part int").parquet(path) for _ in range(2))
    kind = "query_id long, vec_id long, score long"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            left = left.combine_chunks()
            ids, keys, cells = (left.column(c).to_numpy() for c in ("vec_id", "key", "cell"))
            order = np.lexsort((ids, keys, cells))
            x = _matrix(left.column("x").combine_chunks(), dim)[order]
            q = _matrix(right.combine_chunks().column("q").combine_chunks(), dim)
            floor = right.column("floor").to_numpy() if "floor" in right.column_names else None
            for row in search_part(ids[order], x, keys[order], cells[order], right.column("asker").to_numpy(), q, floor, points, norm, k):
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    rings = again.groupBy("part", "cell").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()  # by MOST_PARTS and the pivots
    ring_part, ring_cell = (np.array([r[c] for r in rings], np.int64) for c in ("part", "cell"))
    ring_low, ring_high = (np.array([r[c] for r in rings], float) for c in ("low", "high"))
    parts = int(ring_part.max(initial=0)) + 1  # as dealt, which may be other than asked for
    queries = again.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "x"])  # equal rows lie in one part; a floor counts each once
    tile = (F.col("part").cast("long") * tiles / parts).cast("int").alias("tile")
    asked_by = queries.select(F.col("vec_id").alias("asker"), F.col("x").alias("q"), "part", tile)
    near = index.withColumn("tile", tile).groupBy("part", "tile").cogroup(asked_by.groupBy("part", "tile")).applyInArrow(search, kind)
    floors = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.sort_array(F.collect_list("score"), asc=False).getItem(k - 1)).otherwise(-(2**62)).alias("floor"))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                q = _matrix(pa.concat_arrays([batch.column("q")]), dim)
                able = highest_scores(q, ring_cell, ring_low, ring_high, points, norm) >= batch.column("floor").to_numpy()[:, None].astype(float)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.unique(ring_part[row]).tolist() for row in able], pa.list_(pa.int32()))], [*batch.schema.names, "parts"])

    asking = asked_by.join(floors, F.col("asker") == F.col("query_id"), "left").select("asker", "q", F.coalesce("floor", F.lit(-(2**62))).alias("floor"), "tile")
    asking = stored(asking.mapInArrow(left, "asker long, q array<long>, floor long, tile int, parts array<int>"), f"{path}-asking")
    meet = spark.read.schema(asking.schema).parquet(f"{path}-asking").select(F.explode("parts").alias("part"), "tile").distinct()
    found = index.join(meet, "part").groupBy("part", "tile").cogroup(asking.withColumn("part", F.explode("parts")).drop("parts").groupBy("part", "tile")).applyInArrow(search, kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
