"""Pieces shared by the operators: text rules, row keys, stored intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationloom.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
LARGE_ROW_GROUP = 32 << 20     # bytes of a row group of a table whose rows have megabytes


def stored(df: DataFrame, codec: str | None = None, large_rows: bool = False) -> DataFrame:
    """Write a frame as Parquet into the shared checkpoint folder and read it back: its lineage ends here.

    The file outlives any executor. Unlike ``checkpoint`` it is compressed and can be read column by column. With
    ``large_rows``, of some megabytes each, the writer looks at its memory after every row and not after a hundred,
    and row groups, which are read at once, are small.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    writer = df.write if codec is None else df.write.option("compression", codec)
    if large_rows:
        writer = writer.options(**{"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8,
                                   "parquet.block.size": LARGE_ROW_GROUP})
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, NULL read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` is exact, and faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """Array of the words of a text that is not NULL."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def crc_class(column: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``: the fold of a document. A NULL id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod, F.lit(0))


def buckets_for(rows: int, size: int) -> int:
    """How many hash buckets keep each at about ``size`` rows."""
    return max(1, -(-rows // size))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def worker_memo(name: str, make):
    """An object that one Python worker keeps between its tasks, such as a loaded model or a cache.

    Functions arrive at a worker by value, so their module variables do not outlive a task; an attribute of an
    installed module does. Only ever holds what can be made again.
    """
    import pyspark

    held = pyspark.__dict__.setdefault("_stationloom_memo", {})
    if name not in held:
        held[name] = make()
    return held[name]


def slices(sizes, limit: int):
    """``(start, stop)`` of runs whose sizes add up to ``limit`` at most; a larger item is a run of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)
