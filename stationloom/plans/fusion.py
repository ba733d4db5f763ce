"""Sources to wide table to calendar and reports; lazy until something is written."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationloom.functions import calendar as cal
from stationloom.operators import filters, integrate, normalize, quality, sampling
from stationloom.sources.spec import SourceSpec


def sample_source(spec: SourceSpec, observations: DataFrame, cells: DataFrame, positions: DataFrame | None = None,
                  **columns) -> DataFrame:
    """Sampled source (``station_id, date, value``) for all dates of its period, masked and scaled once.

    Nearest sampling takes the cells' ``positions`` (``cell_id`` and coordinates) and their dated values as ``cells``.
    """
    points = observations
    if spec.start and spec.end:
        points = filters.time_range(points, spec.start, spec.end)
    if spec.sampling == "affine" and spec.every == "day":
        got = sampling.sample_affine(points, cells, spec.grid, **columns)
    elif spec.sampling == "affine" and spec.every == "month":
        got = sampling.sample_monthly(points, _in_years(cells, spec), spec.grid, **columns)
    elif spec.sampling == "affine" and spec.every == "year":
        cells = _in_years(cells, spec)
        got = sampling.sample_affine(points.withColumn("year", F.year("date")), cells, spec.grid, ("year",), **columns)
    elif spec.sampling == "axis":
        got = sampling.sample_axis(points, cells, spec.grid, **columns)
    else:
        if positions is None:
            raise ValueError("nearest sampling needs the positions of the cells")
        got = sampling.sample_nearest(points, positions, cells, **columns)
    return filters.mask_and_scale(got, spec)


def _in_years(cells: DataFrame, spec: SourceSpec) -> DataFrame:
    """Cells of the years of the source's period; the predicate reaches the scan."""
    if "year" not in cells.columns or not (spec.start and spec.end):
        return cells
    return cells.where(F.col("year").between(int(spec.start[:4]), int(spec.end[:4])))


def fuse(sources: Mapping[str, tuple[SourceSpec, DataFrame]], observations: DataFrame | None = None,
         observation_order: str | None = None, altitude: DataFrame | None = None,
         coordinates: Sequence[DataFrame] = (), station_rule: str = "all", calendar: bool = True) -> DataFrame:
    """Normalised sources and observations fused into the wide table, with calendar columns.

    A station rule is applied before anything is merged: ids on every source, a box to the stations whose coordinates
    lie in it, which every source is then restricted to.
    """
    ready = {name: (spec, normalize.standardize(df, date="date" if "date" in df.columns else None))
             for name, (spec, df) in sources.items()}
    seen = None if observations is None else normalize.standardize(observations)
    if station_rule.startswith("ids:"):
        ready = {n: (s, filters.station_filter(d, station_rule)) for n, (s, d) in ready.items()}
        seen = None if seen is None else filters.station_filter(seen, station_rule)
    own = {c for spec, _ in ready.values() for c in integrate.value_names(spec)}
    if station_rule.startswith("bbox:") and coordinates and not own & {"longitude", "latitude"}:
        place = integrate.best_coordinates(coordinates).select(
            "station_id", F.col("_c")["x"].alias("longitude"), F.col("_c")["y"].alias("latitude"))
        inside = filters.station_filter(place, station_rule).select("station_id")
        ready = {n: (s, d.join(inside, "station_id", "left_semi")) for n, (s, d) in ready.items()}
        seen = None if seen is None else seen.join(inside, "station_id", "left_semi")
        altitude = None if altitude is None else altitude.join(inside, "station_id", "left_semi")
    wide = integrate.wide_table(ready, seen, observation_order, altitude, coordinates)
    if station_rule.startswith("bbox:"):
        wide = filters.station_filter(wide, station_rule)
    return cal.with_event_distances(wide) if calendar and "date" in wide.columns else wide


def reports(wide: DataFrame, value: str = "swe") -> dict[str, DataFrame]:
    """The report sheets of a wide table."""
    return {
        "fill_rates": quality.fill_rates(wide),
        "station_coverage": quality.station_coverage(wide, value),
        "overall_coverage": quality.overall_coverage(wide, value),
        "station_time_coverage": quality.station_time_coverage(wide),
        "time_distribution": quality.time_distribution(wide),
        "value_by_month": quality.value_by_month(wide, value),
        "date_validity": quality.date_validity(wide),
        "duplicates": quality.duplicate_count(wide),
    }
