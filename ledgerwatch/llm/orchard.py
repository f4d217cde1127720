"""Clustering around centroids, with nearest centroids found by Orchard's search.

Every centroid has a list of the others by distance from it. For a vector, the search walks
the list of the nearest centroid so far; on meeting a nearer one it goes on with that one's
list. Centroids it has met are marked, so none is measured twice. It stops where the list's
centroids are strictly more than twice as far from the current one as the vector is: by the
triangle inequality all that follow are farther from the vector.

Vectors are whole numbers, so distances, sums and means are exact and reruns agree. A round is
one pass: tasks give back counts and component sums per centroid, one row for each centroid
and task, which Spark adds up. Only the centroids come to the driver and go to the tasks;
their number and width are parameters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready, written

# Steps of a component's grid: 1 / SCALE apart.
SCALE = 1024
def most(width: int) -> int:
    """Largest size of a component for which four times any squared distance fits in a long."""
    return math.isqrt((2**63 - 1) // (16 * max(width, 1)))


def usable(width: int, vector: str = "embedding") -> Column:
    """Exactly ``width`` components, none of them null, infinite or undefined."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of whole numbers, pair by pair."""
    apart = rows - centroids
    return np.einsum("ij,ij->i", apart, apart)


class Orchard:
    """Nearest of some centroids, of equally near ones the one of smaller number."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        k = len(centroids)
        apart = [squared(np.broadcast_to(c, centroids.shape), centroids) for c in centroids]
        # Lists by distance; each starts with its own centroid or one at the same point.
        self.order = np.stack([np.argsort(d, kind="stable") for d in apart]).reshape(k, k)
        self.apart = np.stack([d[o] for d, o in zip(apart, self.order, strict=True)])

    def nearest(self, rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for every row. ``start`` says where its search begins;
        it changes the work, not the answer."""
        n, k = len(rows), len(self.centroids)
        best = start.astype(np.int64)
        distance = squared(rows, self.centroids[best])
        visited = np.zeros((n, k), bool)
        visited[np.arange(n), best] = True
        place = np.zeros(n, np.int64)
        going = np.arange(n)
        while len(going):
            now = best[going]
            # Squared distances: twice as far is four times as much.
            near = self.apart[now, place[going]] <= 4 * distance[going]
            going = going[near]
            other = self.order[best[going], place[going]]
            place[going] += 1
            new = ~visited[going, other]
            asked, other = going[new], other[new]
            visited[asked, other] = True
            away = squared(rows[asked], self.centroids[other])
            closer = (away < distance[asked]) | ((away == distance[asked]) & (other < best[asked]))
            asked = asked[closer]
            best[asked], distance[asked] = other[closer], away[closer]
            place[asked] = 0
            going = going[place[going] < k]
        return best, distance


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component, x in double precision."""
    flat = np.asarray(column.flatten(), np.float64).reshape(len(column), width)
    scaled = np.floor(flat * SCALE)
    if len(scaled) and np.abs(scaled).max() > most(width):
        raise ValueError(f"a component is beyond {most(width)} steps: distances would not fit")
    return scaled.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def _prepare(width: int, centroids: np.ndarray):
    """Whole-number vectors, each with its nearest of the first centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids)
        for batch in batches:
            rows = _integers(batch.column("embedding"), width)
            near, _ = orchard.nearest(rows, np.zeros(len(rows), np.int64))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width)
            steps = pa.ListArray.from_arrays(offsets, pa.array(rows.astype(np.int32).ravel()))
            columns = [batch.column("vec_id"), steps, pa.array(near.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "steps", "start"])

    return run


def _sums(width: int, centroids: np.ndarray):
    """One row for each centroid that a task's vectors are nearest to: count and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids)
        k = len(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            rows = _matrix(batch.column("steps"), width)
            near, _ = orchard.nearest(rows, batch.column("start").to_numpy())
            order = np.argsort(near, kind="stable")
            own, first = np.unique(near[order], return_index=True)
            if len(own):
                total[own] += np.add.reduceat(rows[order], first, axis=0)
            count += np.bincount(near, minlength=k)
        own = np.flatnonzero(count)
        offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * width)
        sums = pa.ListArray.from_arrays(offsets, pa.array(total[own].ravel()))
        columns = [pa.array(own.astype(np.int32)), pa.array(count[own]), sums]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "count", "sums"])

    return run


def _assign(width: int, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orchard = Orchard(centroids)
        for batch in batches:
            rows = _matrix(batch.column("steps"), width)
            near, distance = orchard.nearest(rows, batch.column("start").to_numpy())
            columns = [batch.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return run


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at the componentwise floor of its vectors' mean; those without stay."""
    width = centroids.shape[1]
    parts = vectors.select("steps", "start").mapInArrow(
        _sums(width, centroids), "cluster int, count long, sums array<long>"
    )
    # Decimal sums: a long would overflow beyond some 10^11 vectors.
    sums = parts.select("cluster", "count", F.posexplode("sums").alias("place", "part"))
    sums = sums.groupBy("cluster", "place").agg(
        F.sum("count").alias("count"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")
    )
    moved = centroids.copy()
    # One row for each component of each centroid.
    for row in sums.collect():
        moved[row["cluster"], row["place"]] = int(row["total"]) // row["count"]
    return moved


def _seeds(kept: DataFrame, k: int, width: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least sha256 of ``seed:vec_id``, as whole numbers, in that order."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    named = kept.where("vec_id is not null").select(draw.alias("draw"), "embedding")
    least = named.orderBy("draw", "embedding").limit(k).collect()
    least.sort(key=lambda r: (r["draw"], list(r["embedding"])))
    return _integers(pa.array([list(r["embedding"]) for r in least], pa.list_(pa.float64())), width)


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) for every row of
    ``vectors(vec_id, embedding)`` with exactly ``width`` finite components.

    Components become ``floor(1024 * x)``. The first centroids are the vectors of least
    digest; each round assigns every vector to its nearest centroid by squared Euclidean
    distance, ties to the smaller number, and moves centroids to the floors of the exact
    means; a centroid without vectors stays. A last assignment gives the result. Rounds that
    would move nothing are skipped, as are all after them.

    Other rows take no part. Rows without vec_id are clustered but never start a cluster;
    repeated rows and ids count as often as they occur; with fewer than ``k`` rows to start
    from there are fewer clusters, and with none the result is empty, as for an empty table.
    Further columns are ignored. Sums of distances that exceed a long are null. A component
    so large that distances would not fit (2^26 steps for 64 components) fails the job.
    """
    ready(vectors.sparkSession)
    kept = vectors.where(usable(width)).select(F.col("vec_id").cast("long"), "embedding")
    centroids = _seeds(kept, k, width, seed)
    if not len(centroids):
        kept = kept.where("false")
        centroids = np.zeros((1, width), np.int64)
    prepared = kept.mapInArrow(
        _prepare(width, centroids), "vec_id long, steps array<int>, start int"
    )
    prepared = written(prepared, "steps")
    for _ in range(rounds):
        moved = _moved(prepared, centroids)
        if (moved == centroids).all():
            break
        centroids = moved
    near = prepared.mapInArrow(
        _assign(width, centroids), "vec_id long, cluster int, distance long"
    )
    near = written(near, "assigned")
    spread = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    # One row for each cluster.
    found = {r["cluster"]: int(r["s"]) for r in spread.collect()}
    whole = sum(found.values())
    fits = {c: s if s < 2**63 else None for c, s in found.items()}
    facts = [
        (c, s, whole if whole < 2**63 else None, centroids[c].tolist()) for c, s in fits.items()
    ]
    facts = vectors.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    )
    return near.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def centroid_digest(centroid: str = "centroid") -> Column:
    """sha256 of the components as decimal integers, joined by commas."""
    return F.sha2(F.array_join(F.col(centroid).cast("array<string>"), ","), 256)
