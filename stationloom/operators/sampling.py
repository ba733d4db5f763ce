"""Reading gridded products at points. All dates of a product are sampled in one join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.functions import geo
from stationloom.operators import cells as cellular
from stationloom.sources.spec import GridSpec

KM_PER_DEGREE = math.pi * geo.EARTH_KM / 180


def locate(points: DataFrame, grid: GridSpec, lon: str = "longitude", lat: str = "latitude",
           inside: bool = True) -> DataFrame:
    """Add ``row, col`` of the cell each point falls in; points off the grid go unless ``inside=False``."""
    out = points.withColumns({
        "row": geo.affine_row(F.col(lat), grid.north, grid.dy), "col": geo.affine_col(F.col(lon), grid.west, grid.dx)})
    return out.where(F.col("row").between(0, grid.nrows - 1) & F.col("col").between(0, grid.ncols - 1)) \
        if inside else out


def _at_address(points: DataFrame, cells: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every point with the cells at its address. Without ``on`` all layers of an address match each of its points; a hash
    join lists such rows several times faster than a sorted one, which goes through its buffer of a key for each point.
    """
    return points.join(cells if on else cells.hint("shuffle_hash"), [*on, "row", "col"])


def sample_affine(points: DataFrame, cells: DataFrame, grid: GridSpec, on: Sequence[str] = ("date",),
                  lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Cell values at points: an equi-join on cell address (and date), prunable by ``date``."""
    return _at_address(locate(points, grid, lon, lat), cells, on)


def sample_axis(points: DataFrame, cells: DataFrame, grid: GridSpec, on: Sequence[str] = ("date",), x: str = "x",
                y: str = "y", clamp: bool = True) -> DataFrame:
    """Nearest position on even projected axes (``x0, y0`` are the first centres; y runs south)."""
    col, row = geo.nearest_index(F.col(x), grid.x0, grid.dx), geo.nearest_index(-F.col(y), -grid.y0, grid.dy)
    if clamp:
        col = F.least(F.greatest(col, F.lit(0)), F.lit(grid.ncols - 1))
        row = F.least(F.greatest(row, F.lit(0)), F.lit(grid.nrows - 1))
    return _at_address(points.withColumns({"row": row, "col": col}), cells, on)


def sample_monthly(points: DataFrame, cells: DataFrame, grid: GridSpec, date: str = "date",
                   lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Station days against a monthly grid (``year, month, row, col``)."""
    dated = points.withColumns({"year": F.year(date), "month": F.month(date)})
    return sample_affine(dated, cells, grid, ("year", "month"), lon, lat)


def sample_yearly(stations: DataFrame, years: Sequence[int], cells: DataFrame, grid: GridSpec,
                  lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Every station in every requested year against the grid of that year."""
    station_years = stations.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    return sample_affine(station_years, cells, grid, ("year",), lon, lat)


def nearest_cells(points: DataFrame, cells: DataFrame, cap_km: float = 50.0, lon: str = "longitude",
                  lat: str = "latitude", cell: str = "cell_id", target: int = cellular.TARGET) -> DataFrame:
    """Nearest cell of each distinct point by squared degrees, kept when the great circle is under the cap.

    A cell within ``cap_km`` lies inside a known circle in degrees, so points search that circle only; a
    nearest cell outside it would fail the cap. Near a pole the circle covers all longitudes.
    """
    half = F.lit(cap_km / KM_PER_DEGREE)
    ratio = F.sin(F.radians(half)) / F.cos(F.radians(lat))
    wide = F.when(ratio.between(0, 1), F.degrees(F.asin(ratio))).otherwise(F.lit(180.0))
    place = cellular.vector(lon, lat)
    queries = points.select(lon, lat).dropna().distinct().select(
        place.alias("_w"), (F.sqrt(half * half + wide * wide) * 1.000001).alias("_r"))
    # cells at one position are one candidate: the smallest id
    centres = cells.dropna(subset=[lon, lat]).groupBy(place.alias("_w")).agg(F.min(cell).alias("did"))
    found = cellular.nearest_within(queries.withColumn("qid", F.col("_w")), centres, 1,
                                    cellular.fit_cells(centres, 2, target))
    matched = found.where(F.size("near") > 0).select("qid", F.col("near")[0]["id"].alias("did"))
    joined = matched.join(centres, "did")
    at = {lon: F.col("qid")[0], lat: F.col("qid")[1], "matched_lon": F.col("_w")[0], "matched_lat": F.col("_w")[1]}
    return joined.select(*[c.alias(n) for n, c in at.items()], F.col("did").alias(cell)).withColumn(
        "distance_km", geo.haversine_km(F.col(lat), F.col(lon), F.col("matched_lat"), F.col("matched_lon"))).where(
        F.col("distance_km") < cap_km).select(lon, lat, cell, "matched_lon", "matched_lat", "distance_km")


def sample_nearest(points: DataFrame, cells: DataFrame, values: DataFrame, cap_km: float = 50.0,
                   on: Sequence[str] = ("date",), lon: str = "longitude", lat: str = "latitude",
                   cell: str = "cell_id") -> DataFrame:
    """Values (``cell_id`` and ``on``) of the nearest cell at every point and date."""
    return points.join(nearest_cells(points, cells, cap_km, lon, lat, cell), [lon, lat]).join(values, [cell, *on])


def coverage_report(points: DataFrame, grid: GridSpec, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Points in and out of the grid, extents and negative coordinates."""
    flagged = locate(points, grid, lon, lat, inside=False)
    inside = F.col("row").between(0, grid.nrows - 1) & F.col("col").between(0, grid.ncols - 1)
    return flagged.agg(
        F.count(F.lit(1)).alias("points"), F.count_if(inside).alias("in_bounds"),
        F.count_if(~inside).alias("out_of_bounds"),
        F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"), F.min(lat).alias("min_lat"),
        F.max(lat).alias("max_lat"),
        F.count_if((F.col(lon) < 0) | (F.col(lat) < 0)).alias("negative_coordinates"))
