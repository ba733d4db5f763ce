"""Hydrological calendar: a season starts on 1 September and is labelled by its end or start year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Equinox and solstice dates of the seasons starting in 2012 ... 2018.
EVENT_NAMES = ("autumn_equinox", "winter_solstice", "spring_equinox", "summer_solstice")
EVENT_DATES = {
    2012: ("2012-09-22", "2012-12-21", "2013-03-20", "2013-06-21"),
    2013: ("2013-09-22", "2013-12-21", "2014-03-20", "2014-06-21"),
    2014: ("2014-09-23", "2014-12-21", "2015-03-20", "2015-06-21"),
    2015: ("2015-09-23", "2015-12-22", "2016-03-20", "2016-06-20"),
    2016: ("2016-09-22", "2016-12-21", "2017-03-20", "2017-06-21"),
    2017: ("2017-09-22", "2017-12-21", "2018-03-20", "2018-06-21"),
    2018: ("2018-09-23", "2018-12-21", "2019-03-20", "2019-06-21"),
}


def is_leap(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366


def hydro_year(date: Column, label: str = "end", start_month: int = 9) -> Column:
    """Season label; ``end`` names the year the season ends in, ``start`` the year it begins in."""
    if label == "end":
        return F.year(date) + F.when(F.month(date) >= start_month, 1).otherwise(0)
    if label == "start":
        return F.year(date) - F.when(F.month(date) < start_month, 1).otherwise(0)
    raise ValueError(f"label must be 'end' or 'start', not {label!r}")


def _clamp_doy(value: Column) -> Column:
    # least/greatest skip NULL, so an unknown date must stay NULL explicitly
    return F.when(value.isNotNull(), F.least(F.lit(366), F.greatest(F.lit(1), value)))


def hydro_doy_fixed(date: Column) -> Column:
    """Season day with one offset for all years; a day late from September to December of leap years."""
    doy = F.dayofyear(date)
    return _clamp_doy(F.when(F.month(date) >= 9, doy - 243).otherwise(doy + 122))


def hydro_doy(date: Column) -> Column:
    """Season day counted exactly: 1 September is day 1 in every year."""
    doy = F.dayofyear(date)
    autumn = doy - F.when(is_leap(F.year(date)), 244).otherwise(243)
    return _clamp_doy(F.when(F.month(date) >= 9, autumn).otherwise(doy + 122))


def hydro_doy_from_natural(doy: Column, base: int = 245) -> Column:
    """Season day of a bare day of year, with the day number of 1 September in a leap year as base."""
    return _clamp_doy(F.when(doy >= base, doy - base + 1).otherwise(doy + (365 - base) + 1))


def hydro_doy_in_season(date: Column, end_year: Column) -> Column:
    """Day of ``date`` within a given season, wrapped by 365 when it lies outside."""
    day = F.datediff(date, F.make_date(end_year - 1, F.lit(9), F.lit(1))) + 1
    return F.when(day < 1, day + 365).when(day > 366, day - 365).otherwise(day)


def phenology_date(season_start_year: Column, day: Column, start_month: int = 9, start_day: int = 1) -> Column:
    """Calendar date of the n-th day of a season."""
    start = F.make_date(season_start_year, F.lit(start_month), F.lit(start_day))
    return F.date_add(start, day.cast("int") - 1)


def far_from_target(date: Column, target: Column, days: int = 30) -> Column:
    return F.abs(F.datediff(date, target)) > days


def calendar_parts(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns({
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "doy": F.dayofyear(d),
        "year_month": F.date_format(d, "yyyy-MM"), "month_name": F.date_format(d, "MMMM"),
    })


def event_table(spark: SparkSession, parity: bool = False, last_start_year: int = 2018) -> DataFrame:
    """Seven rows, one per season: ``hydrological_year`` and the four event dates.

    ``parity`` keeps the published lookup, which reads the table by start year with an end-year label and
    so gives every season the next season's dates.
    """
    shift = 0 if parity else 1
    rows = [(year + shift, *dates) for year, dates in EVENT_DATES.items() if year <= last_start_year]
    names = ["hydrological_year", *EVENT_NAMES]
    raw = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if i == 0 else 'string'}" for i, n in enumerate(names)))
    return raw.select("hydrological_year", *[F.col(e).cast(T.DateType()).alias(e) for e in EVENT_NAMES])


def with_event_distances(df: DataFrame, date: str = "date", parity: bool = False) -> DataFrame:
    """Days to each equinox/solstice of the season, the nearest of them and its name (first wins ties)."""
    spark = df.sparkSession
    events = event_table(spark, parity).select(
        "hydrological_year", *[hydro_doy(F.col(e)).alias(f"_{e}") for e in EVENT_NAMES])
    base = df.withColumns({"hydrological_year": hydro_year(F.col(date)), "hydrological_doy": hydro_doy(F.col(date))})
    # fixed seven-row table: a broadcast of constant size
    joined = base.join(F.broadcast(events), "hydrological_year", "left")
    dist = {e: F.abs(F.col("hydrological_doy") - F.col(f"_{e}")) for e in EVENT_NAMES}
    nearest = F.least(*dist.values())
    name = F.lit(None).cast("string")
    for event in reversed(EVENT_NAMES):
        name = F.when(dist[event] == nearest, F.lit(event)).otherwise(name)
    return joined.withColumns({
        **{f"distance_to_{e}": dist[e] for e in EVENT_NAMES},
        "distance_to_nearest_solstice_equinox": nearest,
        "nearest_solstice_equinox": name,
    }).drop(*[f"_{e}" for e in EVENT_NAMES])


def inverse_circular(a: Column, b: Column) -> Column:
    """1 / circular day distance with a period of 365; 1.0 at distance zero."""
    d = F.least(F.abs(a - b), F.abs(a - b - 365), F.abs(a - b + 365))
    return F.when(d == 0, F.lit(1.0).cast("double")).otherwise(1 / d.cast("double"))


def with_inverse_event_distances(df: DataFrame, doy: str = "hydrological_doy", year: str = "hydrological_year",
                                 parity: bool = False) -> DataFrame:
    """Inverse distance of a season day to each event; NULL outside 1..366 or without event dates."""
    last = 2017 if parity else 2018
    events = event_table(df.sparkSession, parity, last).select(
        F.col("hydrological_year").alias("_season"),
        *[hydro_doy_in_season(F.col(e), F.col("hydrological_year")).alias(f"_{e}") for e in EVENT_NAMES])
    joined = df.join(F.broadcast(events), F.col(year) == F.col("_season"), "left")
    valid = F.col(doy).between(1, 366)
    return joined.withColumns({
        f"inverse_dist_{e}": F.when(valid, inverse_circular(F.col(doy), F.col(f"_{e}"))) for e in EVENT_NAMES
    }).drop("_season", *[f"_{e}" for e in EVENT_NAMES])
