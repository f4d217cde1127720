"""Nearest neighbours by a block matrix join with int8 tiles and proven error bounds.

Queries and candidates are cut into blocks; every pair of blocks is one tile, whose size does
not depend on the input. A tile takes products of int8 codes, bounds what rounding can have
changed, and drops candidates that cannot be among a query's nearest in the tile. The rest is
recomputed from the original vectors in double precision; each tile keeps a heap per query, and
the heaps of all tiles are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready, written

QUERY_BLOCK = 1024
BLOCK = 8192
# Rows of a tile that one matrix product takes.
STRIP = 2048


def usable(vector: str = "embedding") -> Column:
    """Not null, not zero, without null, infinite or undefined components."""
    x = F.col(vector)
    finite = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    return x.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and the step of each row: unit is within half a step of step * code."""
    step = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    return codes, step


def bounds(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosines of unit vectors, from int8 codes alone.

    With x = s(p + e) and y = t(q + f), every |e|, |f| at most a half, x.y differs from
    s t p.q by at most s t (|p| / 2 + |q| / 2 + d / 4), |.| the sum of absolute values. The
    products of codes are whole numbers that single precision holds exactly up to 1,000
    dimensions; beyond that they are taken in double precision.
    """
    p, s = quantise(queries)
    q, t = quantise(candidates)
    kind = np.float32 if p.shape[1] <= 1000 else np.float64
    product = p.astype(kind) @ q.astype(kind).T
    scale = s[:, None] * t[None, :]
    slack = 0.5 * np.abs(p).sum(axis=1, dtype=np.int64)[:, None]
    slack = slack + 0.5 * np.abs(q).sum(axis=1, dtype=np.int64)[None, :] + 0.25 * p.shape[1]
    # A hair more, for the rounding of the scales themselves.
    slack = scale * slack * (1 + 1e-9) + 1e-9
    middle = scale * product
    return middle - slack, middle + slack


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision. Each is summed within its own row, so that equal vectors
    have equal values whatever stands beside them."""
    dots = (rows * query).sum(axis=1)
    norms = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum())
    return dots / norms


class Nearest:
    """Heap of the k nearest: greater score first, then smaller id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.heap: list[tuple[float, int]] = []

    def add(self, score: float, vec_id: int) -> None:
        item = (score, -vec_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            heapq.heapreplace(self.heap, item)

    def ranked(self) -> list[tuple[float, int]]:
        return [(s, -i) for s, i in sorted(self.heap, reverse=True)]


def tile_nearest(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int):
    """[(score, id)] of the k nearest candidates of each query."""
    unit_q = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
    heaps = [Nearest(k) for _ in queries]
    for begin in range(0, len(candidates), STRIP):
        rows = candidates[begin : begin + STRIP]
        unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
        low, high = bounds(unit_q, unit)
        if len(rows) > k:
            floor = np.partition(low, len(rows) - k, axis=1)[:, len(rows) - k]
        else:
            floor = np.full(len(queries), -np.inf)
        for i, heap in enumerate(heaps):
            least = max(floor[i], heap.heap[0][0] - 1e-12) if len(heap.heap) == k else floor[i]
            near = np.flatnonzero(high[i] >= least)
            for score, j in zip(cosines(queries[i], rows[near]).tolist(), near, strict=True):
                heap.add(score, int(ids[begin + j]))
    return [h.ranked() for h in heaps]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def _tiles(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = [], []
        if left.num_rows and right.num_rows:
            near = tile_nearest(
                _matrix(left.column("embedding")),
                _matrix(right.column("embedding")),
                right.column("vec_id").to_numpy(),
                k,
            )
            for query, heap in zip(left.column("query").to_pylist(), near, strict=True):
                ids += [query] * len(heap)
                found += heap
        return pa.table(
            {
                "query": pa.array(ids, pa.int64()),
                "score": pa.array([s for s, _ in found], pa.float64()),
                "vec_id": pa.array([i for _, i in found], pa.int64()),
            }
        )

    return run


def _merge(k: int):
    """Heaps of all tiles of a query into one; the rows come sorted by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heap, out = None, Nearest(k), []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("query", "score", "vec_id"))
            for query, score, vec_id in zip(*columns, strict=True):
                if query != current:
                    out += [(current, r + 1, i, s) for r, (s, i) in enumerate(heap.ranked())]
                    current, heap = query, Nearest(k)
                heap.add(score, vec_id)
            if len(out) >= 1024:
                yield _ranked(out)
                out = []
        out += [(current, r + 1, i, s) for r, (s, i) in enumerate(heap.ranked())]
        yield _ranked(out)

    return run


def _ranked(rows) -> pa.RecordBatch:
    query, rank, vec_id, score = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query, pa.int64()),
            pa.array(rank, pa.int32()),
            pa.array(vec_id, pa.int64()),
            pa.array(score, pa.float64()),
        ],
        ["query", "rank", "vec_id", "score"],
    )


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine for every row that
    ``is_query`` holds for, nearest first, ties to the smaller vec_id, never the query's own id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    rows without vec_id; vectors of different length are never compared. Equal vectors are
    compared once: of each set of equal vectors only the k + 1 smallest ids can be among
    anyone's nearest, so the others are left out without changing any result. Repeated rows
    of an id count once per different vector. Further columns are ignored; an empty table
    gives an empty result.
    """
    ready(vectors.sparkSession)
    rows = vectors.where(usable() & F.col("vec_id").isNotNull())
    rows = rows.select(
        F.col("vec_id").cast("long"),
        F.transform("embedding", lambda v: v.cast("double")).alias("embedding"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).distinct()
    rows = written(rows, "vectors")
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    candidates = (
        rows.select("vec_id", "embedding")
        .distinct()
        .withColumn("place", F.row_number().over(alike))
        .where(F.col("place") <= k + 1)
        .drop("place")
    )
    # A query stands for all queries with its vector: the smallest id names them.
    asked = rows.where("asks").groupBy("embedding").agg(F.min("vec_id").alias("query"))
    asked = written(asked, "asked")
    width = F.size("embedding").alias("width")
    counts = {r.width: r.n for r in asked.groupBy(width).agg(F.count("*").alias("n")).collect()}
    sizes = {
        r.width: r.n for r in candidates.groupBy(width).agg(F.count("*").alias("n")).collect()
    }
    # Blocks per vector length: one row per length in use.
    grid = [(w, -(-n // QUERY_BLOCK), -(-sizes[w] // BLOCK)) for w, n in counts.items()]
    spark = vectors.sparkSession
    grid = F.broadcast(spark.createDataFrame(grid, "width int, q_blocks long, c_blocks long"))
    left = (
        asked.withColumn("width", F.size("embedding"))
        .join(grid, "width")
        .withColumn("q_block", F.pmod(F.xxhash64("query"), F.col("q_blocks")))
        .withColumn("c_block", F.explode(F.expr("sequence(0L, c_blocks - 1)")))
    )
    right = (
        candidates.withColumn("width", F.size("embedding"))
        .join(grid, "width")
        .withColumn("c_block", F.pmod(F.xxhash64("vec_id"), F.col("c_blocks")))
        .withColumn("q_block", F.explode(F.expr("sequence(0L, q_blocks - 1)")))
    )
    tile = ["width", "q_block", "c_block"]
    near = (
        left.select(*tile, "query", "embedding")
        .groupBy(*tile)
        .cogroup(right.select(*tile, "vec_id", "embedding").groupBy(*tile))
        .applyInArrow(_tiles(k + 1), "query long, score double, vec_id long")
    )
    merged = near.repartition("query").sortWithinPartitions("query")
    merged = merged.mapInArrow(_merge(k + 1), "query long, rank int, vec_id long, score double")
    merged = merged.where("query is not null")
    # Back to every query with that vector, less its own id.
    named = rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding")
    named = named.join(asked, "embedding").select("query_id", "query")
    best = named.join(merged, "query").where(F.col("query_id") != F.col("vec_id"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
