"""Sinks. Every writer takes a DataFrame and leaves a folder; nothing passes through the driver."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def range_name(name: str, start: str, end: str) -> str:
    return f"{name}_{start.replace('-', '')}_{end.replace('-', '')}"


def write_both(df: DataFrame, folder: str, name: str, start: str, end: str,
               partition_by: Sequence[str] = (), csv: bool = True, mode: str = "overwrite") -> tuple[str, ...]:
    """Parquet and CSV copies with the date range in the name."""
    base = f"{folder.rstrip('/')}/{range_name(name, start, end)}"
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{base}.parquet")
    if csv:
        df.write.mode(mode).option("header", True).csv(f"{base}.csv")
        return f"{base}.parquet", f"{base}.csv"
    return (f"{base}.parquet",)


def write_sheets(sheets: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> dict[str, str]:
    """One folder per report sheet."""
    paths = {}
    for sheet, df in sheets.items():
        paths[sheet] = f"{folder.rstrip('/')}/{sheet}"
        df.write.mode(mode).option("header", True).csv(paths[sheet])
    return paths


def write_evaluation(predictions: DataFrame, folds: DataFrame, importance: DataFrame, summary: DataFrame,
                     folder: str, mode: str = "overwrite") -> dict[str, str]:
    """Predictions as Parquet, fold and importance tables as CSV, the summary as JSON lines."""
    base = folder.rstrip("/")
    predictions.write.mode(mode).parquet(f"{base}/predictions")
    folds.write.mode(mode).option("header", True).csv(f"{base}/folds")
    importance.write.mode(mode).option("header", True).csv(f"{base}/importance")
    summary.write.mode(mode).json(f"{base}/summary")
    return {k: f"{base}/{k}" for k in ("predictions", "folds", "importance", "summary")}


def write_sorted(df: DataFrame, path: str, keys: Sequence[str] = ("station_id", "date"), files: int | None = None,
                 mode: str = "overwrite") -> None:
    """Totally ordered files by range partitioning; a hot station is cut at its dates."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode(mode).parquet(path)


MANIFEST = "manifest.json"
# Text with quotes comes back as it was, and an empty text is not NULL; only a text that is \N itself comes back as NULL.
CSV = {"header": "true", "escape": '"', "nullValue": "\\N"}


@dataclass(frozen=True)
class Output:
    """One of several tables to publish; ``format`` is parquet, csv, json or orc."""

    df: DataFrame
    format: str = "parquet"
    partition_by: tuple[str, ...] = ()


def publish(outputs: Mapping[str, Output], folder: str, spark: SparkSession) -> str:
    """Write several tables so that readers see all of them or none; returns the version's name.

    Every call writes a new version folder. When all outputs are there a manifest replaces the one before by a rename,
    and only the manifest tells readers where tables are. If an output fails its version is removed and the error
    raised; what was published before stays as it was. Earlier versions are kept for readers that still use them.
    No outputs are a version without tables.

    The folder's file system has to replace a file by rename at once, as HDFS and local ones do.
    """
    base, version = folder.rstrip("/"), uuid.uuid4().hex
    place = f"{base}/versions/{version}"
    try:
        listed = {}
        for name, output in outputs.items():
            writer = output.df.write.mode("error").options(**(CSV if output.format == "csv" else {}))
            (writer.partitionBy(*output.partition_by) if output.partition_by else writer).format(output.format).save(
                f"{place}/{name}")
            listed[name] = {"format": output.format, "schema": output.df.schema.jsonValue()}
        _replace(spark, f"{place}/{MANIFEST}", f"{base}/{MANIFEST}", json.dumps({"version": version, "outputs": listed}))
    except BaseException:
        path, files, _ = _files(spark, place)
        files.delete(path, True)
        raise
    return version


def published_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables of the published version; none before the first one."""
    found = _manifest(spark, folder)
    return sorted(found["outputs"]) if found else []


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the published version, with the types and column order it was written with."""
    found = _manifest(spark, folder)
    if not found or name not in found["outputs"]:
        raise ValueError(f"{name} is not published in {folder}")
    entry = found["outputs"][name]
    schema = StructType.fromJson(entry["schema"])
    reader = spark.read.schema(schema).options(**(CSV if entry["format"] == "csv" else {}))
    return reader.format(entry["format"]).load(f"{folder.rstrip('/')}/versions/{found['version']}/{name}").select(
        *[f"`{c}`" for c in schema.names])


def _files(spark: SparkSession, path: str):
    """The path, its file system, and the interface with the replacing rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)


def _replace(spark: SparkSession, draft: str, final: str, text: str) -> None:
    source, files, context = _files(spark, draft)
    out = files.create(source, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(source, _files(spark, final)[0], options)


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    path, files, _ = _files(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    if not files.exists(path):
        return None
    return json.loads(spark.read.text(path.toString(), wholetext=True).first()[0])


def period_outputs(df: DataFrame, name: str, start: str, end: str, partition_by: Sequence[str] = ()) -> dict[str, Output]:
    """Parquet and CSV copies of a table with the date range in their names, for ``publish``."""
    base = range_name(name, start, end)
    return {f"{base}.parquet": Output(df, "parquet", tuple(partition_by)), f"{base}.csv": Output(df, "csv")}


def sheet_outputs(sheets: Mapping[str, DataFrame]) -> dict[str, Output]:
    """Report sheets for ``publish``."""
    return {name: Output(df, "csv") for name, df in sheets.items()}


def evaluation_outputs(predictions: DataFrame, folds: DataFrame, importance: DataFrame, summary: DataFrame
                       ) -> dict[str, Output]:
    """The tables of an evaluation for ``publish``."""
    return {"predictions": Output(predictions), "folds": Output(folds, "csv"),
            "importance": Output(importance, "csv"), "summary": Output(summary, "json")}
