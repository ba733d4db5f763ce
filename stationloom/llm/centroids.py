"""Centroid clusters of integer vectors, with a filter in rotated coordinates.

Every vector is stored with its coordinates on the leading principal axes and the norm of what is left of it. For a
vector and a centroid, the squared distance of these coordinates plus the squared difference of the norms is never more
than their squared distance. Only centroids whose bound does not exceed the exact distance to the best-bounded one are
compared in integers; everything that decides is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm.common import stored
from stationloom.llm.moments import SMALL, axes, column_sums, covariance, matrix, scaled

SCALE, WIDTH, CLUSTERS, ROUNDS, LEADING = 64, 64, 16, 3, 12
PAIRS = 32_768                 # vector-centroid pairs compared in integers at once


class Rotation:
    """Principal axes of a table of vectors."""

    def __init__(self, mean: np.ndarray, axes_: np.ndarray) -> None:
        self.mean, self.axes = mean, axes_

    @classmethod
    def of(cls, table: DataFrame, width: int, leading: int) -> Rotation:
        n, sums = column_sums(table, "_v", width)
        mean = np.array([s / max(n, 1) for s in sums])
        return cls(mean, axes(covariance(table, "_v", mean, n))[1][:, :leading])

    def __call__(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the rest."""
        centred = vectors.astype(np.float64) - self.mean
        lead = centred @ self.axes
        return lead, np.sqrt(np.maximum((centred * centred).sum(axis=1) - (lead * lead).sum(axis=1), 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``a`` to that of ``b``; wide integers where 64 bits might not do."""
    if max(np.abs(a.astype(np.float64)).max(initial=0), np.abs(b.astype(np.float64)).max(initial=0)) < SMALL:
        d = a - b
        return np.einsum("ij,ij->i", d, d)
    return ((a.astype(object) - b.astype(object)) ** 2).sum(axis=1)


def nearest(vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray,
            rotation: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every vector: number of the nearest centroid (the smaller at a tie), squared distance, centroids compared."""
    c_lead, c_rest = rotation(centroids)
    bound = ((lead * lead).sum(axis=1)[:, None] - 2 * lead @ c_lead.T + (c_lead * c_lead).sum(axis=1)
             + (rest[:, None] - c_rest) ** 2)
    # rounding: of coordinates as large as the vectors themselves
    slack = 1e-9 * ((lead * lead).sum(axis=1) + rest * rest + (c_lead * c_lead).sum(axis=1).max() + (c_rest ** 2).max()
                    + (rotation.mean ** 2).sum() + 1)
    best = bound.argmin(axis=1)
    least = squared(vectors, centroids[best])
    row, other = np.nonzero(bound <= (least.astype(np.float64) * (1 + 1e-12) + slack)[:, None])
    new = other != best[row]
    row, other = row[new], other[new]
    compared = 1 + np.bincount(row, minlength=len(vectors))
    for at in range(0, len(row), PAIRS):
        r, c = row[at:at + PAIRS], other[at:at + PAIRS]
        found = squared(vectors[r], centroids[c])
        for i, k, d in zip(r.tolist(), c.tolist(), found.tolist()):
            if d < least[i] or d == least[i] and k < best[i]:
                least[i], best[i] = d, k
    return best, least, compared


def _fits(value: int) -> int | None:
    return int(value) if value < 1 << 63 else None


def assign(table: DataFrame, centroids: np.ndarray, rotation: Rotation, kind: str) -> DataFrame:
    """``_id, cluster, distance, verified`` per vector; ``verified`` counts the centroids compared in integers."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, lead = matrix(batch.column(1), width), matrix(batch.column(2), rotation.axes.shape[1])
            best, least, compared = nearest(vectors, lead, batch.column(3).to_numpy(), centroids, rotation)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(best.astype(np.int32)), pa.array([_fits(d) for d in least.tolist()], pa.int64()),
                pa.array(compared.astype(np.int32))], ["_id", "cluster", "distance", "verified"])

    return table.select("_id", "_v", "_lead", "_rest").mapInArrow(
        run, f"_id {kind}, cluster int, distance long, verified int")


def moved(table: DataFrame, centroids: np.ndarray, rotation: Rotation) -> np.ndarray:
    """The centroids after one round: exact floor of the mean of their vectors. Tasks send sums and counts."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            vectors, lead = matrix(batch.column(0), width), matrix(batch.column(1), rotation.axes.shape[1])
            best = nearest(vectors, lead, batch.column(2).to_numpy(), centroids, rotation)[0]
            exact = np.abs(vectors.astype(np.float64)).max(initial=0) < SMALL
            for k in np.unique(best).tolist():
                own = vectors[best == k]
                sums[k] += (own if exact else own.astype(object)).sum(axis=0).astype(object)
                counts[k] += len(own)
        for k in np.nonzero(counts)[0].tolist():
            yield pa.RecordBatch.from_arrays([
                pa.array([k], pa.int32()), pa.array([int(counts[k])]), pa.array([[str(s) for s in sums[k]]])],
                ["cluster", "n", "sums"])

    parts = table.select("_v", "_lead", "_rest").mapInArrow(run, "cluster int, n long, sums array<string>")
    added = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("decimal(38,0)").alias("s")).collect()
    out = centroids.copy()
    for row in added:
        out[row["cluster"], row["i"]] = int(row["s"]) // row["n"]
    return out


def cluster(table: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE,
            clusters: int = CLUSTERS, rounds: int = ROUNDS, leading: int = LEADING) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per kept vector.

    Vectors of another length, and those with a NULL or non-finite entry, are left out; entries beyond 64 bits are cut
    to the largest. Centroids start at the vectors whose ``1:<key>`` has the smallest sha256; rows without a key start
    none, rows that repeat a key stand in the order of their vectors, and a table with fewer rows has fewer centroids.
    No row with a key, or an empty table: no rows. Repeated rows are kept and counted. A distance or inertia that
    does not fit a long is NULL. Other columns are not read.
    """
    spark, kind = table.sparkSession, dict(table.dtypes)[key]
    kept = table.select(F.col(key).alias("_id"), scaled(vector, scale).alias("_v")).where(F.size("_v") == width)
    kept = stored(kept, codec="zstd")
    first = kept.where(F.col("_id").isNotNull()).select("_v", F.sha2(F.concat(F.lit("1:"), F.col("_id").cast("string")), 256).alias(
        "_h")).orderBy("_h", "_v").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], f"_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string").withColumnRenamed("_id", key)
    rotation = Rotation.of(kept, width, min(leading, width))

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation(matrix(batch.column(1), width))
            bounds = pa.array(np.arange(len(lead) + 1) * lead.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(
                bounds, pa.array(lead.reshape(-1))), pa.array(rest)], ["_id", "_v", "_lead", "_rest"])

    rotated = stored(kept.mapInArrow(rotate, f"_id {kind}, _v array<long>, _lead array<double>, _rest double"), codec="zstd")
    centroids = np.array([r["_v"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = moved(rotated, centroids, rotation)
    found = stored(assign(rotated, centroids, rotation, kind))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
                                                                      F.count_if(F.col("distance").isNull()).alias("odd")).where(
        "odd = 0").collect()}
    total = _fits(int(sum(sums.values()))) if len(sums) == found.select("cluster").distinct().count() else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, type_: F.array(*[F.lit(v).cast(type_) for v in values])[F.col("cluster")]
    own = [_fits(int(sums[k])) if k in sums else None for k in range(len(centroids))]
    return found.select(F.col("_id").alias(key), "cluster", "distance", of(own, "long").alias("cluster_inertia"),
                        F.lit(total).cast("long").alias("inertia"), of(digest, "string").alias("centroid_sha256"))
