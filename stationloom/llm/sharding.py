"""Weighted rendezvous hashing of stable keys, with gapless places inside every shard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationloom.llm.common import buckets_for, text_of

SLOT_ROWS = 50_000


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """``-ln(u) / weight`` with u uniform in (0, 1), drawn from the md5 of key and shard number; the lowest wins."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2 ** 52)
    return -F.log(u) / weight


def key_text(key: str) -> Column:
    """A stable key as text; all NULL keys are one key."""
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """``struct(score, shard)`` of the winning shard. Shards without weight get nothing."""
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("at least one shard needs a positive weight")
    table = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in live])
    return F.array_min(F.transform(table, lambda s: F.struct(
        _score(key, s["shard"], s["weight"]).alias("score"), s["shard"].alias("shard"))))


def with_slots(df: DataFrame, shard: str, order: Sequence[str], name: str = "slot",
               rows_per_task: int = SLOT_ROWS) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in md5 order of the ``order`` columns.

    The leading digits of the md5 are even buckets, as many as the counted size asks for: only the bucket sizes are
    added up per shard, and a task orders one bucket. Rows equal in all ``order`` columns are interchangeable.
    """
    digits, wanted = 0, buckets_for(df.count(), rows_per_task)
    while 16 ** digits < wanted:
        digits += 1
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    base = df.withColumn("_md5", F.md5(text.cast("binary"))).withColumn("_bucket", F.substring("_md5", 1, digits))
    sizes = base.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_bucket").orderBy("_md5", *order)
    return base.join(starts, [shard, "_bucket"]).withColumn(
        name, F.col("_start") + F.row_number().over(inside) - 1).drop("_md5", "_bucket", "_start")


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text",
                  grown_by: float | None = None, rows_per_task: int = SLOT_ROWS) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` per row.

    The key and the weights decide alone, so adding a shard of weight ``grown_by`` (the last weight when not given)
    moves rows only into it. All rows without a key share one shard. ``size`` is the text's UTF-8 bytes plus 1, NULL
    read as empty. Repeated rows get places of their own.
    """
    weights = [float(w) for w in weights]
    k = key_text(key)
    extra = F.lit(len(weights))
    joining = _score(k, extra, F.lit(weights[-1] if grown_by is None else float(grown_by)))
    rows = docs.select(
        F.col(key), (F.octet_length(text_of(text)) + 1).cast("bigint").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"), rendezvous(k, weights).alias("_best"),
        joining.alias("_new"))
    rows = rows.select(key, "size", "text_crc32", F.lit("key").alias("law"), F.col("_best.shard").alias("shard"),
                       F.when(F.col("_new") < F.col("_best.score"), extra).otherwise(F.col("_best.shard")).alias(
                           "grown_shard"))
    return with_slots(rows, "shard", [key, "size", "text_crc32"], rows_per_task=rows_per_task).select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
