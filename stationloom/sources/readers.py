"""Scans. Filters and column lists are plain predicates, so Parquet and JDBC readers push them down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_HEADER = ("ncols", "nrows", "xllcenter", "yllcenter", "cellsize", "nodata_value")  # fixed values


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   encoding: str = "utf-8", sep: str = ",") -> DataFrame:
    """CSV with an explicit encoding (``utf-8``, ``latin1``, ``gbk``); give a schema to avoid a second pass.

    Encodings outside Unicode and latin1 need ``spark.sql.legacy.javaCharsets``, which ``build_session`` sets.
    """
    encoding = "iso-8859-1" if encoding.lower() in ("latin1", "latin-1") else encoding
    reader = spark.read.option("header", True).option("encoding", encoding).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
              partitions: int, **options: str) -> DataFrame:
    """Station table of a database, read in parallel ranges of a numeric column."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, **options).load()


def station_scan(df: DataFrame, columns: Sequence[str], date: str = "date", start: str | None = None,
                 end: str | None = None) -> DataFrame:
    """Projection and time range of the station table."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast(df.schema[date].dataType))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast(df.schema[date].dataType))
    return df.select(*columns)


def only_ids(df: DataFrame, ids: DataFrame, key: str = "station_id") -> DataFrame:
    """Rows whose key is in a table of ids; Spark broadcasts the ids when they are measured to be small."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def ascii_header(text: Column) -> dict[str, Column]:
    """The six header entries of an ASCII grid as columns."""
    return {name: F.regexp_extract(text, rf"(?im)^\s*{name}\s+(\S+)", 1).cast("double") for name in ASCII_HEADER}


def ascii_grid_cells(files: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell of ASCII grids held one text per row: ``row`` from the north, ``col``, ``value``, ``x``, ``y``.

    No-data cells are NULL. A grid is one file and so one task, as it has to be read whole.
    """
    t = F.col(text)
    head = files.select(*keep, t.alias("_text"), *[c.alias(f"_{n}") for n, c in ascii_header(t).items()])
    lines = head.withColumn("_lines", F.slice(F.split(F.trim("_text"), r"\r?\n"), 7, 1 << 30))
    rows = lines.select("*", F.posexplode("_lines").alias("row", "_line"))
    cells = rows.select("*", F.posexplode(F.split(F.trim("_line"), r"\s+")).alias("col", "_cell"))
    number = F.col("_cell").try_cast("double")
    return cells.where((F.col("row") < F.col("_nrows")) & (F.col("col") < F.col("_ncols"))).select(
        *keep, "row", "col", F.when(number != F.col("_nodata_value"), number).alias("value"),
        (F.col("_xllcenter") + F.col("col") * F.col("_cellsize")).alias("x"),
        (F.col("_yllcenter") + (F.col("_nrows") - 1 - F.col("row")) * F.col("_cellsize")).alias("y"))


def read_ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every ASCII grid file under a path, dated by the eight digits in the file name."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("text"), F.col("_metadata.file_name").alias("file_used"))
    return ascii_grid_cells(files.withColumn("date", file_date(F.col("file_used"))), keep=("date", "file_used"))


def file_date(name: Column) -> Column:
    """Date in a file name: eight digits, or year, month and day joined by ``-`` or ``_``."""
    compact = F.regexp_extract(name, r"(\d{8})", 1)
    dashed = F.translate(F.regexp_extract(name, r"(\d{4}[-_]\d{2}[-_]\d{2})", 1), "-_", "")
    text = F.when(compact != "", compact).otherwise(dashed)
    return F.try_to_timestamp(F.when(text != "", text), F.lit("yyyyMMdd")).cast("date")


def file_sensor(name: Column, sensors: Sequence[str]) -> Column:
    """Sensor part of ``<sensor>_SWE_<date>_...``; NULL when it is not in the list."""
    sensor = F.regexp_extract(name, r"^(.+)_SWE_\d{8}", 1)
    return F.when(sensor.isin(*sensors), sensor)


def first_sensor(df: DataFrame, sensors: Sequence[str], sensor: str = "sensor", date: str = "date") -> DataFrame:
    """Rows of the first sensor of an ordered list that exists on each date."""
    priority = F.array_position(F.array(*[F.lit(s) for s in sensors]), F.col(sensor))
    known = df.withColumn("_priority", priority).where(F.col("_priority") > 0)
    best = known.groupBy(date).agg(F.min("_priority").alias("_priority"))
    return known.join(best, [date, "_priority"], "left_semi").drop("_priority")


def date_spine(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per day of each range."""
    return bounds.select(F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))).alias("date"))


def unstack_bands(df: DataFrame, bands: str, first_day: str, keep: Sequence[str] = ()) -> DataFrame:
    """Band n of a stack is day n of its period: one row per day."""
    rows = df.select(*keep, F.col(first_day).alias("_first"), F.posexplode(bands).alias("band", "value"))
    return rows.select(*keep, F.date_add("_first", F.col("band")).alias("date"), "band", "value")
