"""Whitening of embeddings from the covariance of their distinct integer vectors.

Equal vectors are grouped first; a distinct vector enters the fit with weight one, or with its number of rows. Its
centred products are added up as matrix products inside Spark tasks. Every distinct vector is whitened once and the
result joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.llm.common import stored
from stationloom.llm.moments import axes, column_sums, covariance, matrix, scaled

SCALE, COMPONENTS = 256, 4
LEAST = 1e-12                  # share of the largest eigenvalue below which a component has no spread


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of squares of ``n * x - sums``, exactly; None where it does not fit a long."""
    largest = max(int(np.abs(x.astype(np.float64)).max(initial=0)), 1)
    if x.shape[1] * (n * largest + max(map(abs, sums), default=0)) ** 2 < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    wide = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in wide]


def _of_width(rows: DataFrame, width: int, weights: str, components: int) -> DataFrame | None:
    """``_id, component, n, deviation, whitened, explained, identity_error`` of the vectors of one length."""
    distinct = stored(rows.groupBy("_x").agg(F.count(F.lit(1)).alias("_rows")), codec="zstd")
    weight = "_rows" if weights == "counts" else None
    n, sums = column_sums(distinct, "_x", width, weight)
    mean = np.array([s / n for s in sums])
    values, vectors = axes(covariance(distinct, "_x", mean, n, weight))
    kept = int((values[:components] > LEAST * max(values[0], 0)).sum()) if values[0] > 0 else 0
    if not kept:
        return None
    basis, trace = vectors[:, :kept] / np.sqrt(values[:kept]), values.sum()

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), width)
            white = (x - mean) @ basis
            bounds = pa.array(np.arange(len(x) + 1) * kept, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(_deviation(x, n, sums), pa.int64()),
                pa.ListArray.from_arrays(bounds, pa.array(white.reshape(-1)))], ["_x", "_rows", "_deviation", "_white"])

    white = stored(distinct.mapInArrow(whiten, "_x array<long>, _rows long, _deviation long, _white array<double>"), codec="zstd")
    centre = white.select(*[(F.sum(F.col("_white")[i] * (F.col(weight) if weight else F.lit(1))) / n).alias(str(i))
                            for i in range(kept)]).first()
    error = np.abs(covariance(white, "_white", np.array(centre), n, weight) - np.eye(kept)).max()
    share = F.array(*[F.lit(float(v / trace)) for v in values[:kept]])
    joined = rows.join(white.select("_x", "_deviation", "_white"), "_x")
    return joined.select("_id", "_deviation", F.posexplode("_white").alias("_c", "whitened")).select(
        "_id", (F.col("_c") + 1).alias("component"), F.lit(n).cast("long").alias("n"),
        F.col("_deviation").alias("deviation"), "whitened", share[F.col("_c")].alias("explained"),
        F.lit(float(error)).alias("identity_error"))


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", weights: str = "one",
           components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row per row and component.

    ``weights`` is ``one`` or ``counts``: how a distinct vector counts in the fit. Rows without a vector, or with a NULL
    or non-finite entry, are left out; entries beyond 64 bits are cut to the largest. Vectors of different lengths are
    fitted apart. Components without spread (a single distinct vector, fewer dimensions than components) are not
    returned. ``deviation`` is NULL where it does not fit a long. Repeated rows and NULL keys are kept; an empty table
    gives no rows; other columns are not read.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights must be 'one' or 'counts'")
    rows = stored(table.select(F.col(key).alias("_id"), scaled(vector, scale).alias("_x")).where(F.size("_x") > 0), codec="zstd")
    widths = [r[0] for r in rows.select(F.size("_x").alias("w")).distinct().orderBy("w").collect()]
    parts = [_of_width(rows.where(F.size("_x") == w), w, weights, components) for w in widths]
    found = [p for p in parts if p is not None]
    if not found:
        empty = (f"_id {dict(table.dtypes)[key]}, component int, n long, deviation long, whitened double, "
                 "explained double, identity_error double")
        return table.sparkSession.createDataFrame([], empty).withColumnRenamed("_id", key)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("_id", key)
