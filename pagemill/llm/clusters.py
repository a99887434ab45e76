"""Exact k-means over integer vectors by annulus search.

A vector keeps `dims` components and turns each into floor(scale * x). Centroids are sorted by norm. For a vector the
distance to the centroid of the nearest norm is an upper bound u of its least distance; by the triangle inequality a
nearer centroid, or one as near, has a norm within u of the vector's. Binary search finds that annulus among the sorted
norms, widened by more than floating point can err, so ties on its edge stay in; its centroids are compared exactly, in
whole numbers, and the bound shrinks as nearer ones are found.

A round is one pass: each task adds up its vectors by cluster and emits a row for each cluster, so what is shuffled
is (tasks * centroids) rows, and the driver gets one row for each centroid. Nothing is carried from round to round but the centroids,
so a lost executor costs its tasks only; distances are recomputed in the last pass rather than stored.

Defined cases: vectors that are null, of another length or with a null or non-finite component are left out; a component
beyond 2^27 in absolute value after scaling counts as 2^27, for squared distances have to fit a long; a sum of distances that
doesn't fit is null; vectors without an id are assigned but start no centroid; of equal ids the smaller vector starts first;
repeated rows are vectors of their own; with fewer vectors than centroids there are as many centroids as vectors that may start;
where none may, and in an empty table, there are no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import tuned

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
#: Vectors that a Python worker gets at once.
BATCH = 8192
#: Largest absolute value of a component: 64 squared differences of twice that fit a long.
MOST = 1 << 27
_LONG = (1 << 63) - 1


def kept(vectors: DataFrame, id_column: str, column: str, dims: int) -> DataFrame:
    """id and vec of the vectors that count."""
    x = F.col(column)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    return vectors.select(F.col(id_column).alias("id"), x.cast("array<double>").alias("vec")).where(x.isNotNull() & (F.size(x) == dims) & whole)


def scaled(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Whole components of a list column, a row for each vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(scale * flat), -MOST, MOST).astype(np.int64).reshape(-1, dims)


class Annulus:
    """Nearest centroids by search among sorted norms."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.squares = (centroids * centroids).sum(1)
        self.order = np.lexsort((np.arange(len(centroids)), self.squares))
        self.sorted, self.norms = centroids[self.order], np.sqrt(self.squares[self.order].astype(float))

    def distances(self, x: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """Exact squared distances of vectors to sorted centroids (one for each vector, or one for all)."""
        off = x - self.sorted[at]
        return np.einsum("ij,ij->i", off, off)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid (ties: the smaller number), and how many were compared."""
        norm = np.sqrt((x * x).sum(1).astype(float))
        right = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(self.norms) - 1))
        start = right - (norm - self.norms[right - 1] <= self.norms[np.minimum(right, len(self.norms) - 1)] - norm)
        start = np.minimum(start, len(self.norms) - 1)
        best, number, compared = self.distances(x, start), self.order[start], np.ones(len(x), np.int32)
        reach = self._reach(best, norm)
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        for step in range(1, len(self.norms)):  # outwards from the first, so that the bound shrinks early
            for j in (start - step, start + step):
                at = np.flatnonzero((j >= low) & (j < high))
                at = at[np.abs(self.norms[j[at]] - norm[at]) <= reach[at]]
                if not len(at):
                    continue
                d, n = self.distances(x[at], j[at]), self.order[j[at]]
                compared[at] += 1
                win = (d < best[at]) | (d == best[at]) & (n < number[at])
                at = at[win]
                best[at], number[at] = d[win], n[win]
                reach[at] = self._reach(best[at], norm[at])
        return number, best, compared

    @staticmethod
    def _reach(squared: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The bound, wider by more than the square roots and their difference can be off."""
        root = np.sqrt(squared.astype(float))
        return root + 1e-6 + 1e-12 * (root + norm)


def _pass(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> dict[int, tuple[int, list[int], int]]:
    """Count, sums and summed distances of the vectors of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        n, sums, far = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64), [0] * len(centroids)
        for b in batches:
            x = scaled(b.column(0), dims, scale)
            number, squared, _ = search.nearest(x)
            n += np.bincount(number, minlength=len(n))
            for j in np.unique(number):
                sums[j] += x[number == j].sum(0)
                own = squared[number == j]
                far[j] += int((own >> 31).sum()) << 31
                far[j] += int((own & ((1 << 31) - 1)).sum())
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(n[some]), pa.array([Decimal(far[j]) for j in some], pa.decimal128(38, 0)), *[pa.array(sums[some, i]) for i in range(dims)]], ["cluster", "n", "far", *[f"s{i}" for i in range(dims)]]
        )

    names = ["n", "far", *[f"s{i}" for i in range(dims)]]
    parts = vectors.select("vec").mapInArrow(run, f"cluster int, n long, far decimal(38,0), {', '.join(f's{i} long' for i in range(dims))}")
    found = parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in names]).collect()  # a row for each centroid
    return {r["cluster"]: (r["n"], [r[f"s{i}"] for i in range(dims)], int(r["far"])) for r in found}


def first_centroids(vectors: DataFrame, k: int, seed: str, dims: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest digests of seed and id, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.where("id is not null").select(digest.alias("digest"), "vec").orderBy("digest", "vec").limit(k).collect()
    return np.clip(np.floor(scale * np.array([r["vec"] for r in rows], float)), -MOST, MOST).astype(np.int64).reshape(-1, dims)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per vector: its id, cluster, squared distance, cluster_inertia and inertia, centroid_sha256, and n_compared, the centroids compared with it in the last pass."""
    spark = tuned(vectors.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    rows, kind = kept(vectors, id_column, column, dims), dict(vectors.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_compared int"
    centroids = first_centroids(rows, k, seed, dims, scale)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        for j, (n, sums, _far) in _pass(rows, centroids, dims, scale).items():
            centroids[j] = [s // n for s in sums]
    far = {j: f for j, (_, _, f) in _pass(rows, centroids, dims, scale).items()}
    fits = lambda x: x if x <= _LONG else None
    own = pa.array([fits(far.get(j, 0)) for j in range(len(centroids))], pa.int64())
    whole, digests = fits(sum(far.values())), pa.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for b in batches:
            number, squared, compared = search.nearest(scaled(b.column(1), dims, scale))
            number = pa.array(number, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), number, pa.array(squared), own.take(number), pa.array([whole] * len(b), pa.int64()), digests.take(number), pa.array(compared)], [id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_compared"]
            )

    return rows.mapInArrow(run, schema)
