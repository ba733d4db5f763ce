"""Row predicates, value masks and input validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom.functions import scalar
from stationloom.sources.spec import SourceSpec

# Acquisition stamps that are not observation dates.
BAD_DATES = ("2025-10-10", "2025-10-11")


def station_filter(df: DataFrame, rule: str, lon: str = "longitude", lat: str = "latitude",
                   station: str = "station_id") -> DataFrame:
    """``all``, ``bbox:minx,miny,maxx,maxy`` or ``ids:a,b,c``; all become scan predicates."""
    if rule == "all":
        return df
    kind, _, value = rule.partition(":")
    parts = [p.strip() for p in value.split(",") if p.strip()]
    if kind == "bbox":
        west, south, east, north = (float(p) for p in parts)
        return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))
    if kind == "ids":
        return df.where(F.col(station).isin(*parts))
    raise ValueError(f"unknown station filter {rule!r}")


def time_range(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    kind = df.schema[date].dataType
    return df.where(F.col(date).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def mask_and_scale(df: DataFrame, spec: SourceSpec, value: str = "value") -> DataFrame:
    """Drop fill and out-of-range values, then scale once."""
    v = F.col(value)
    keep = v.isNotNull() & ~F.isnan(v.cast("double"))
    if spec.fill is not None:
        keep = keep & (v != spec.fill)
    if spec.valid_min is not None:
        keep = keep & (v >= spec.valid_min)
    if spec.valid_max is not None:
        keep = keep & (v <= spec.valid_max)
    return df.where(keep).withColumn(value, scalar.scale_offset(v.cast("double"), spec.scale, spec.offset, spec.unit))


def fill_to_null(df: DataFrame, columns: Sequence[str], fill: float = -9999.0) -> DataFrame:
    """Fill values become NULL; rows with nothing left go."""
    return df.withColumns({c: scalar.null_if(F.col(c), fill) for c in columns}).dropna("all", subset=list(columns))


def is_bad_date(date: Column, bad: Sequence[str] = BAD_DATES) -> Column:
    """NULL where there is no date."""
    return F.to_date(date).isin(*[F.lit(b).cast("date") for b in bad])


def drop_bad_dates(df: DataFrame, date: str = "date", bad: Sequence[str] = BAD_DATES) -> DataFrame:
    found = is_bad_date(F.col(date), bad)
    return df.where(found.isNull() | ~found)


def column_variety(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, is_constant``: one pass with minimum and maximum, no distinct count."""
    stats = df.agg(*[F.struct(F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi"),
                              F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("flat")).alias(c) for c in columns])
    return stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c)["flat"].alias("is_constant")) for c in columns])).alias("r")
    ).select("r.*")


def drop_constant_columns(train: DataFrame, columns: Sequence[str], *frames: DataFrame) -> tuple[DataFrame, ...]:
    """Remove columns with at most one value in the training rows from it and from the other frames."""
    flat = [r["column"] for r in column_variety(train, columns).where("is_constant").collect()]  # one row per column
    return tuple(f.drop(*flat) for f in (train, *frames))


def validation_report(df: DataFrame, required: Sequence[str], station: str = "station_id",
                      min_stations: int = 2) -> DataFrame:
    """Missing columns, rows, stations and whether the input can be used."""
    missing = [c for c in required if c not in df.columns]
    stations = F.count_distinct(station) if station in df.columns else F.lit(0).cast("bigint")
    present = [c for c in required if c in df.columns]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in present], F.lit(True))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), stations.alias("stations"), F.count_if(complete).alias("complete_rows"),
    ).select("*", F.lit(",".join(missing)).alias("missing_columns"),
             (F.lit(not missing) & (F.col("stations") >= min_stations)).alias("valid"))


def require(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
