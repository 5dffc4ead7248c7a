"""Centroid clustering of integer-coded vectors: exact k-means by float64 matrix products.

A vector of exactly `dims` finite components is coded as floor(scale * x), an integer each; all others are left out. A round
broadcasts the centroids (count x dims integers), each task assigns its rows in blocks, and the sums and counts for each
centroid, one small table a task, are combined by treeAggregate of the RDD of these tables; the driver holds count x dims numbers.

Distances are |x|**2 - 2 x.c + |c|**2 in blocked float64 products. With all magnitudes at most SMALL every number on the way is
an integer below 2 ** 53 (64 components: 4 * 64 * 2 ** 44), so the float result is the integer. Larger rows or
centroids go through 64-bit integers up to MEDIUM, and beyond through Python's. Rows up to SMALL skip a centroid above MEDIUM if
there is one up to SMALL, as that is always nearer. Sums are exact at any size.

Ties go to the smaller number. An empty centroid stays. Repeated rows count each. A null vec_id hashes as the empty string and is
carried along. Equal hashes (repeated vec_ids) are put in order by their components. Fewer vectors than centroids:
as many centroids. Distances and sums beyond 64 bits are returned as the largest 64-bit integer. Empty table: empty result. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import operator
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

COUNT, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Magnitudes up to which float64 products and 64-bit sums of squares of 64 components are exact; rows of a block.
SMALL, MEDIUM, BLOCK = 1 << 22, 1 << 27, 4096
LARGEST = (1 << 63) - 1


def coded(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """vec_id, v (array<bigint> of floor(scale * x)) and, where that outgrows 64 bits, x (array<double>) in its place."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where((F.size("x") == dims) & finite)
    fits = F.forall("x", lambda c: F.abs(c * scale) < 2.0**62)
    return rows.select("vec_id", F.when(fits, F.transform("x", lambda c: F.floor(c * scale))).alias("v"), F.when(~fits, F.col("x")).alias("x"))


def integers(values: list[float], scale: int) -> list[int]:
    """floor(scale * x) without rounding."""
    out = []
    for x in values:
        top, bottom = float(x).as_integer_ratio()
        out.append(top * scale // bottom)
    return out


def table(v: pa.Array, x: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows x dims of 64-bit integers, or of Python's where a row needs them."""
    if not x.null_count == len(x):
        rows = [a if a is not None else integers(b, scale) for a, b in zip(v.to_pylist(), x.to_pylist(), strict=True)]
        return np.array(rows, object).reshape(-1, dims)
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid, as integers. centroids: Python's integers."""
    reach = np.array([max(map(abs, c)) for c in centroids.tolist()], object)
    size = np.abs(rows).max(1)
    place, far = np.zeros(len(rows), np.int64), np.zeros(len(rows), object)
    low = reach <= SMALL
    inside = (size <= SMALL).astype(bool)
    easy = inside if low.any() else np.zeros(len(rows), bool)
    near = reach <= MEDIUM
    if easy.any():
        x, c = rows[easy].astype(np.float64), centroids[low].astype(np.float64)
        found = np.full((len(x), len(centroids)), LARGEST)
        found[:, low] = ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
        for k in np.flatnonzero(near & ~low):
            gap = rows[easy].astype(np.int64) - np.array(centroids[k], np.int64)
            found[:, k] = (gap * gap).sum(1)
        place[easy] = found.argmin(1)
        far[easy] = found.min(1)
    if (rest := ~easy).any():
        kind = np.int64 if near.all() and size[rest].max() <= MEDIUM else object
        x = rows[rest].astype(kind)
        found = np.stack([((x - np.array(c, kind)) ** 2).sum(1) for c in centroids.tolist()], 1)
        place[rest] = found.argmin(1)
        far[rest] = found.min(1)
    return place, far


def sums(rows: np.ndarray, place: np.ndarray, count: int) -> np.ndarray:
    """count x (dims + 1) of Python's integers: sums of components and, last, how many rows."""
    one = np.zeros((count, len(rows)))
    one[place, np.arange(len(rows))] = 1
    if rows.dtype != object and len(rows) and np.abs(rows).max() <= SMALL:
        total = (one @ rows.astype(np.float64)).astype(np.int64).astype(object)  # BLOCK * SMALL: far below 2 ** 53
    else:
        total = np.zeros((count, rows.shape[1]), object)
        for k in np.unique(place):
            total[k] = rows[place == k].astype(object).sum(0)
    return np.hstack([total, one.sum(1).astype(np.int64).astype(object)[:, None]])


def _blocks(batch: pa.RecordBatch, dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for lo in range(0, batch.num_rows, BLOCK):
        part = batch.slice(lo, BLOCK)
        yield part, table(part.column(1), part.column(2), dims, scale)


def _summed(centroids: np.ndarray, dims: int, scale: int):
    """One row a task: the sums of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dims + 1), object)
        for batch in batches:
            for _, rows in _blocks(batch, dims, scale):
                total = total + sums(rows, nearest(rows, centroids)[0], len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total.tolist())])], names=["sums"])

    return run


def _assigned(centroids: np.ndarray, dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in _blocks(batch, dims, scale):
                place, far = nearest(rows, centroids)
                far = np.array([min(int(d), LARGEST) for d in far], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(place.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(
    vectors: DataFrame, count: int = COUNT, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector kept, and the final centroids (count x dims integers)."""
    spark = vectors.sparkSession
    kept = saved(coded(vectors, id_col, vector_col, dims, scale))
    hashed = kept.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    first = hashed.orderBy("hash", "v", "x").limit(count).select("v", "x").collect()  # `count` rows
    centroids = np.array([list(r.v) if r.v is not None else integers(r.x, scale) for r in first], object).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        parts = kept.mapInArrow(_summed(centroids, dims, scale), "sums binary").rdd.map(lambda r: np.array(pickle.loads(r[0]), object))
        total = parts.treeAggregate(np.zeros((len(centroids), dims + 1), object), operator.add, operator.add, depth=2)
        full = total[:, dims] > 0
        centroids = centroids.copy()
        centroids[full] = total[full, :dims] // total[full, dims:]
    return kept.mapInArrow(_assigned(centroids, dims, scale), "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with the distances summed over each cluster and over all, and a digest of each cluster's centroid."""
    assigned = saved(assigned)
    totals = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each centroid
    own = [(k, min(totals.get(k, 0), LARGEST), min(sum(totals.values()), LARGEST), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    small = assigned.sparkSession.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
