"""Names, ids, dates, duplicates and codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom.functions import scalar
from stationloom.operators.ranking import running_sums

# Accepted spellings of the key columns.
ALIASES = {
    "station_ID": "station_id", "Station_ID": "station_id", "Longitude": "longitude", "Lon": "longitude",
    "lon": "longitude", "Latitude": "latitude", "Lat": "latitude", "lat": "latitude",
}


def rename_aliases(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Rename known spellings, only where the target name is still free."""
    taken, plan = set(df.columns), {}
    for source, target in aliases.items():
        if source in df.columns and target not in taken:
            plan[source] = target
            taken.add(target)
    return df.withColumnsRenamed(plan)


def standardize(df: DataFrame, station: str = "station_id", date: str | None = "date") -> DataFrame:
    """Aliases, text ids and day dates in one projection; rows without an id go."""
    df = rename_aliases(df)
    columns = {station: scalar.canonical_id(F.col(station))}
    if date and date in df.columns:
        kind = dict(df.dtypes)[date]
        d = F.col(date)
        if kind == "string":
            columns[date] = scalar.parse_date(d)
        elif kind in ("int", "bigint", "double", "float"):
            columns[date] = scalar.decode_numeric_date(d)
        else:
            columns[date] = d.cast("date")
    return df.withColumns(columns).where(F.col(station).isNotNull())


def drop_time_columns(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """What is left of a static source: no date parts."""
    time = {"date", "year", "month", "day", "time", "doy"}
    return df.drop(*[c for c in df.columns if c.lower() in time or c in extra])


def valid_coordinates(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    return df.withColumns({lon: scalar.coordinate(F.col(lon)), lat: scalar.coordinate(F.col(lat))}).dropna(
        subset=[lon, lat])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in an explicit order, and among equals in the order of the other columns.

    An aggregate rather than a window: copies of a key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ties = [c for c in rest if "map<" not in dict(df.dtypes)[c] and dict(df.dtypes)[c] != "variant"]
    by = F.struct(*order, *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)])
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def removed_duplicates(df: DataFrame) -> DataFrame:
    """Rows before and after a full-row distinct."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("removed"))


def composite_key(*columns: str, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])


def row_ids(df: DataFrame, order: str, name: str = "id") -> DataFrame:
    """Ids 0, 1, 2 ... in the order of a unique numeric column."""
    ranked = running_sums(df, order, [], {})
    return ranked.withColumn(name, F.col("_rank") - 1).drop("_rank")


def category_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Sorted distinct values numbered from 0; NULL is a class of its own and comes last."""
    classes = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = running_sums(classes, column, [], {}).select(column, (F.col("_rank") - 1).alias(code))
    last = classes.agg(F.count(F.lit(1))).scalar()
    coded = df.join(codes, column, "left")
    return coded.withColumn(code, F.when(F.col(column).isNull(), last).otherwise(F.col(code)))


def class_labels(df: DataFrame, classes: DataFrame, code: str, label: str) -> DataFrame:
    """Label of a class code, ``Class_<code>`` for unknown ones. ``classes`` has ``code, label`` once per code."""
    table = classes.select(F.col(classes.columns[0]).alias("_code"), F.col(classes.columns[1]).alias("_label"))
    joined = df.join(table, F.col(code) == F.col("_code"), "left")
    return joined.withColumn(label, F.coalesce("_label", F.concat(F.lit("Class_"), F.col(code).cast("string")))).drop(
        "_code", "_label")
