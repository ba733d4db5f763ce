"""Coverage, distribution, consistency and duplicate reports. One frame per report, one pass where possible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationloom.functions.scalar import guarded_percent, known
from stationloom.operators.ranking import exact_quantiles, null_safe, running_sums


def _rows() -> Column:
    return F.count(F.lit(1))


def tall(df: DataFrame, columns: Sequence[str], name: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """Several numeric columns as ``name, value`` rows."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), list(columns), name, value)


def station_coverage(df: DataFrame, value: str = "swe", station: str = "station_id") -> DataFrame:
    per = df.groupBy(station).agg(_rows().alias("records"), F.count(known(F.col(value))).alias("valid"))
    return per.withColumn("coverage_pct", guarded_percent(F.col("valid"), F.col("records")))


def overall_coverage(df: DataFrame, value: str = "swe", station: str = "station_id") -> DataFrame:
    return station_coverage(df, value, station).agg(
        _rows().alias("stations"), F.sum("records").alias("records"), F.sum("valid").alias("valid"),
        F.avg("records").alias("avg_records"), F.avg("coverage_pct").alias("avg_coverage_pct"))


def station_time_coverage(df: DataFrame, station: str = "station_id", date: str = "date") -> DataFrame:
    """First, last and counts per station. Months and years are reduced before counting, so there is no distinct."""
    months = df.groupBy(station, F.year(date).alias("y"), F.month(date).alias("m")).agg(
        F.min(date).alias("first"), F.max(date).alias("last"), _rows().alias("n"))
    return months.groupBy(station).agg(
        F.min("first").alias("first_date"), F.max("last").alias("last_date"), F.sum("n").alias("records"),
        F.min("y").alias("min_year"), F.max("y").alias("max_year"),
        F.size(F.collect_set("y")).alias("n_years"), F.size(F.collect_set("m")).alias("n_months"))


def station_year_coverage(df: DataFrame, station: str = "station_id", date: str = "date") -> DataFrame:
    return station_time_coverage(df, station, date).select(station, "min_year", "max_year", "n_years")


def time_distribution(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows per year, per month and per year-month: grouping sets over one partial aggregate."""
    days = df.groupBy(F.year(date).alias("y"), F.month(date).alias("m")).agg(_rows().alias("n"))
    def level(name: str, period: Column) -> Column:
        return F.struct(F.lit(name).alias("level"), period.alias("period"))

    keyed = days.select("n", F.explode(F.array(
        level("year", F.col("y").cast("string")), level("month", F.col("m").cast("string")),
        level("year_month", F.format_string("%04d-%02d", "y", "m")))).alias("k"))
    return keyed.groupBy(F.col("k")["level"].alias("level"), F.col("k")["period"].alias("period")).agg(
        F.sum("n").alias("records"))


def value_by_month(df: DataFrame, value: str = "swe", date: str = "date", station: str = "station_id") -> DataFrame:
    per = df.where(F.col(value).isNotNull()).groupBy(
        F.date_format(date, "yyyy-MM").alias("year_month"), station).agg(_rows().alias("n"))
    return per.groupBy("year_month").agg(_rows().alias("stations"), F.sum("n").alias("records"))


def date_validity(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(
        _rows().alias("records"), F.count(date).alias("valid_dates"), F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    ).withColumn("valid_pct", guarded_percent(F.col("valid_dates"), F.col("records")))


def time_summary(df: DataFrame, value: str = "swe", station: str = "station_id", date: str = "date") -> DataFrame:
    """Station and time figures of the whole table in one row."""
    per = df.groupBy(station).agg(
        _rows().alias("n"), F.count(value).alias("v"), F.min(date).alias("first"), F.max(date).alias("last"))
    return per.agg(
        _rows().alias("stations"), F.sum("n").alias("records"), F.sum("v").alias("valid_values"),
        F.min("first").alias("first_date"), F.max("last").alias("last_date"), F.avg("n").alias("avg_records"),
    ).withColumn("coverage_pct", guarded_percent(F.col("valid_values"), F.col("records")))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per class; NULL is reported as a class."""
    counts = df.groupBy(column).agg(_rows().alias("records"))
    total = df.agg(_rows().alias("n")).scalar()
    return counts.withColumn("pct", guarded_percent(F.col("records"), total))


def fill_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, filled, records, fill_pct`` of every column from one global aggregate."""
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    stats = df.agg(_rows().alias("_n"), *[
        F.count(known(F.col(c)) if kinds[c] in ("double", "float") else c).alias(c) for c in columns])
    return stats.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])).alias("r")).select(
        F.col("r")["column"].alias("column"), F.col("r")["filled"].alias("filled"), F.col("_n").alias("records"),
        guarded_percent(F.col("r")["filled"], F.col("_n")).alias("fill_pct"))


def all_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])
    return df.agg(_rows().alias("records"), F.count_if(empty).alias("all_null"))


def consistency(df: DataFrame, columns: Sequence[str], station: str = "station_id") -> DataFrame:
    """Stations with at most one value per column, and their share; minimum against maximum, no distinct."""
    per = df.groupBy(station).agg(*[
        F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns])
    stats = per.agg(_rows().alias("_n"), *[F.count_if(F.col(c)).alias(c) for c in columns])
    return stats.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("consistent")) for c in columns])).alias("r")).select(
        F.col("r")["column"].alias("column"), F.col("r")["consistent"].alias("consistent"),
        F.col("_n").alias("stations"), guarded_percent(F.col("r")["consistent"], F.col("_n")).alias("pct"))


def station_fill(df: DataFrame, column: str, station: str = "station_id") -> DataFrame:
    """Whether each station has the column always, or at least once."""
    return df.groupBy(station).agg(
        F.bool_and(F.col(column).isNotNull()).alias("full"), F.bool_or(F.col(column).isNotNull()).alias("any"))


def station_means(df: DataFrame, columns: Sequence[str], station: str = "station_id") -> DataFrame:
    return df.groupBy(station).agg(*[F.avg(c).alias(c) for c in columns])


def value_summary(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Count, minimum, maximum, mean, median and sample deviation, overall or per group; NaN is missing."""
    v = known(F.col(value))
    stats = df.groupBy(*group).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"))
    median = exact_quantiles(df, value, {"median": 0.5}, group)
    if group:
        return null_safe(stats, median, group, "left")
    return stats.withColumn("median", median.scalar())


def pivot_counts(df: DataFrame, row: str, column: str, classes: Sequence[str]) -> DataFrame:
    """Rows per ``row`` and listed class, 0 where there are none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == c).alias(c) for c in classes])


def features_wide(df: DataFrame, features: Sequence[str], feature: str = "feature", value: str = "value",
                  order: str | None = None, station: str = "station_id") -> DataFrame:
    """Long features to one row per station; a known feature list needs no pre-scan."""
    picks = []
    for name in features:
        hit = F.when(F.col(feature) == name, F.col(value))
        picks.append((F.min_by(F.col(value), F.when(F.col(feature) == name, F.col(order))) if order
                      else F.max(hit)).alias(name))
    return df.groupBy(station).agg(*picks)


# Bounds of the sample-size classes.
SIZE_CLASSES = (("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4-10", 4, 10), ("11-50", 11, 50), ("51-100", 51, 100),
                (">100", 101, None))


def sample_size_histogram(df: DataFrame, station: str = "station_id") -> DataFrame:
    """Stations and samples per sample-size class; classes without stations are left out."""
    per = df.groupBy(station).agg(_rows().alias("n"))
    label = F.lit(None).cast("string")
    for name, low, high in reversed(SIZE_CLASSES):
        label = F.when((F.col("n") >= low) & (F.col("n") <= (high or 1 << 62)), F.lit(name)).otherwise(label)
    return per.groupBy(label.alias("size_class")).agg(_rows().alias("stations"), F.sum("n").alias("samples"))


def small_station_share(df: DataFrame, limit: int = 3, station: str = "station_id") -> DataFrame:
    per = df.groupBy(station).agg(_rows().alias("n"))
    small = F.col("n") <= limit
    return per.agg(
        _rows().alias("stations"), F.count_if(small).alias("small_stations"), F.sum("n").alias("samples"),
        F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("small_samples"),
    ).withColumns({"small_station_pct": guarded_percent(F.col("small_stations"), F.col("stations")),
                   "small_sample_pct": guarded_percent(F.col("small_samples"), F.col("samples"))})


def duplicate_rows(df: DataFrame, name: str = "duplicate_group", station: str = "station_id",
                   date: str = "date") -> DataFrame:
    """All rows of repeated keys with ``copies`` and a group number counted from 0 in key order.

    Repeated keys are found by an aggregate. Stations get running offsets, and inside a station only its
    repeated dates are numbered, so no window runs over the rows.
    """
    repeated = df.groupBy(station, date).agg(_rows().alias("copies")).where("copies > 1")
    per = repeated.groupBy(station).agg(_rows().alias("_n"))
    offsets = running_sums(per.where(F.col(station).isNotNull()), station, [], {"_upto": "_n"}).select(
        station, (F.col("_upto") - F.col("_n")).alias("_before"))
    # keys with a missing part count too: a missing station comes first, a missing date first inside its station
    missing = per.where(F.col(station).isNull()).agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    place = F.when(F.col(station).isNull(), 0).otherwise(F.col("_before") + missing)
    numbered = null_safe(repeated, offsets, [station], "left").withColumn(
        name, place + F.row_number().over(Window.partitionBy(station).orderBy(date)) - 1).drop("_before")
    return null_safe(df, numbered, [station, date])


def duplicate_count(df: DataFrame, keys: Sequence[str] = ("station_id", "date")) -> DataFrame:
    per = df.groupBy(*keys).agg(_rows().alias("n"))
    return per.agg(F.sum("n").alias("records"), _rows().alias("keys"), F.sum(F.col("n") - 1).alias("duplicates"))


def integrity(df: DataFrame, protected: Sequence[str], keys: Sequence[str] = ("station_id", "date"),
              leap: str = "is_leap_year", nearest: str = "distance_to_nearest_solstice_equinox") -> DataFrame:
    """One-row integrity block: size, stations, range, coverage, duplicates, leap share, nearest-event distance."""
    per = df.groupBy(*keys).agg(
        _rows().alias("n"), F.count_if(F.col(leap)).alias("leap"), F.sum(nearest).alias("ds"),
        F.count(nearest).alias("dn"), F.min(nearest).alias("dlo"), F.max(nearest).alias("dhi"),
        *[F.count(c).alias(f"c_{c}") for c in protected])
    per_station = per.groupBy(keys[0]).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("dup"), F.sum("leap").alias("leap"), F.sum("ds").alias("ds"),
        F.sum("dn").alias("dn"), F.min("dlo").alias("dlo"), F.max("dhi").alias("dhi"), F.min(keys[1]).alias("first"),
        F.max(keys[1]).alias("last"), *[F.sum(f"c_{c}").alias(f"c_{c}") for c in protected])
    total = F.sum("n")
    return per_station.agg(
        total.alias("rows"), _rows().alias("stations"), F.min("first").alias("first_date"),
        F.max("last").alias("last_date"), F.sum("dup").alias("duplicates"),
        guarded_percent(F.sum("leap"), total).alias("leap_pct"),
        (F.sum("ds") / F.nullif(F.sum("dn"), F.lit(0))).alias("nearest_mean"), F.min("dlo").alias("nearest_min"),
        F.max("dhi").alias("nearest_max"),
        *[guarded_percent(F.sum(f"c_{c}"), total).alias(f"{c}_pct") for c in protected])


def source_inventory(frames: Mapping[str, DataFrame], station: str = "station_id", date: str = "date") -> DataFrame:
    """Rows, stations and dates per source. Distinct keys are counted by aggregates of aggregates."""
    stacked = reduce(DataFrame.unionByName, [
        f.select(F.lit(name).alias("source"), station, date) for name, f in frames.items()])
    return stacked.groupBy("source").agg(
        _rows().alias("records"), F.count_distinct(station).alias("stations"), F.count_distinct(date).alias("dates"))


def onehot_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows by the sum of their indicator columns."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])
    return df.groupBy(F.least(total, F.lit(2)).alias("row_sum")).agg(_rows().alias("records"))


def processing_yield(spine: DataFrame, loaded: DataFrame, date: str = "date") -> DataFrame:
    """Requested dates, dates with data, failed dates and the success rate."""
    have = loaded.select(date).distinct().withColumn("_have", F.lit(1))
    return spine.join(have, date, "left").agg(
        _rows().alias("requested"), F.count("_have").alias("done"),
        F.count_if(F.col("_have").isNull()).alias("failed"),
    ).withColumn("success_pct", guarded_percent(F.col("done"), F.col("requested")))


def fill_station_nulls(df: DataFrame, columns: Sequence[str], order: str, station: str = "station_id") -> DataFrame:
    """Station's first known value, by ``order``, written to its NULLs (aggregate and lookup, no window)."""
    first = df.groupBy(station).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_first_{c}") for c in columns])
    return df.join(first, station, "left").withColumns(
        {c: F.coalesce(c, f"_first_{c}") for c in columns}).drop(*[f"_first_{c}" for c in columns])
