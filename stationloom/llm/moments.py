"""Centred second moments of integer vectors, added up in Spark tasks as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 1 << 26                # below it, sums of squared differences of vectors fit 64 bits


def scaled(vector: str, factor: int) -> Column:
    """``floor(factor * c)`` of every entry as a long; NULL where the vector or an entry is NULL or not finite."""
    entry = lambda c: F.floor(c.cast("double") * F.lit(float(factor))).cast("long")
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(False)), F.transform(vector, entry))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of one array."""
    return np.asarray(column.flatten()).reshape(-1, width)


def column_sums(table: DataFrame, vector: str, width: int, weight: str | None = None) -> tuple[int, list[int]]:
    """Total weight and exact weighted sum of every component."""
    own = F.lit(1) if weight is None else F.col(weight)
    wide = "decimal(38,0)"
    sums = table.select(own.alias("_w"), F.posexplode(vector).alias("_i", "_v")).groupBy("_i").agg(
        F.sum(F.col("_v").cast(wide) * F.col("_w")).cast(wide).alias("_s"), F.sum("_w").alias("_n")).collect()
    total = [0] * width
    for row in sums:
        total[row["_i"]] = int(row["_s"])
    return (int(sums[0]["_n"]) if sums else 0), total


def covariance(table: DataFrame, vector: str, mean: np.ndarray, total: int, weight: str | None = None) -> np.ndarray:
    """Covariance with divisor ``total``: every task centres its vectors, multiplies them as one matrix and sends the
    rows of its sum; the rows of all tasks are added in the order of their size, so reruns agree."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = None
        for batch in batches:
            centred = matrix(batch.column(0), width) - mean
            weights = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            part = centred.T @ (centred * weights[:, None])
            added = part if added is None else added + part
        if added is not None:
            at, to = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(to.astype(np.int32)),
                                              pa.array(added[at, to])], ["i", "j", "v"])

    weights = F.lit(1) if weight is None else F.col(weight)
    parts = table.select(vector, weights.cast("long").alias("_w")).mapInArrow(run, "i int, j int, v double")
    ordered = F.aggregate(F.array_sort(F.collect_list("v")), F.lit(0.0), lambda a, v: a + v)     # one entry a task
    found = parts.groupBy("i", "j").agg(ordered.alias("v")).toArrow()
    out = np.zeros((width, width))
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    return (out + np.triu(out, 1).T) / max(total, 1)


def axes(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, the largest first, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh(cov)
    return values[::-1], vectors[:, ::-1]
