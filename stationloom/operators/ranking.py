"""Exact ranks, running sums and quantiles without an unpartitioned window over the data.

A window with no partition, ``percentile`` and ``median`` all bring a whole group into one task. The
functions below first cut the order into buckets of even size, add up the buckets (a table whose size is
the number of buckets, not the number of rows) and then finish inside each bucket, so one group holding a
third of the rows is spread like any other.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the right copies of the keys are dropped."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])
    return left.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def cut_points(df: DataFrame, value: str, buckets: int = BUCKETS) -> Column:
    """Sorted array of up to ``buckets`` values: the lowest-hash value of every hash class, an even sample."""
    h = F.xxhash64(value)
    picked = df.where(F.col(value).isNotNull()).groupBy(F.pmod(h, F.lit(buckets)).alias("_class")).agg(
        F.min_by(value, h).alias("_cut"))
    return picked.agg(F.sort_array(F.collect_list("_cut")).alias("_cuts")).scalar()


def _bisect(value: str, first: str, stride: int, low: int, high: int) -> str:
    """How many of the cuts ``first + stride*i`` (i in low ... high-1) lie at or below the value, as a decision tree."""
    if low == high:
        return str(low)
    mid = (low + high) // 2
    # a position past the end reads NULL and goes left
    return (f"if(get(_cuts, {first} + {stride * mid}) <= {value}, {_bisect(value, first, stride, mid + 1, high)}, "
            f"{_bisect(value, first, stride, low, mid)})")


def with_bucket(df: DataFrame, value: str, buckets: int = BUCKETS) -> DataFrame:
    """Add ``_bucket``: how many cut points lie at or below the value.

    One small decision tree per base-4 digit keeps the generated method short enough to be compiled; an array
    function with a lambda would be interpreted for every row.
    """
    digits = max(1, math.ceil(math.log(buckets, 4)))
    located = df.withColumn("_cuts", cut_points(df, value, 4 ** digits)).withColumn("_bucket", F.lit(0))
    for level in reversed(range(digits)):
        stride = 4 ** level
        last = 4 if level == 0 else 3
        digit = _bisect(f"`{value}`", f"_bucket + {stride - 1}", stride, 0, last)
        located = located.withColumn("_bucket", F.expr(f"_bucket + {stride} * {digit}"))
    return located.drop("_cuts")


def running_sums(df: DataFrame, order: str, tie: Sequence[str], sums: Mapping[str, str], group: Sequence[str] = (),
                 descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Running totals ``{output: input}`` in the order of a column without NULLs (numeric when descending).

    ``df`` should already be one row per distinct position (aggregate first). Also adds ``_rank``, the
    position inside the group counted from 1.
    """
    group = list(group)
    key = "_order"
    base = df.withColumn(key, -F.col(order) if descending else F.col(order))
    base = with_bucket(base, key, buckets)
    totals = base.groupBy(*group, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_s_{o}") for o in sums])
    inner = Window.partitionBy(*group, "_bucket").orderBy(key, *tie)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = null_safe(base, offsets, [*group, "_bucket"])
    return joined.withColumns({
        "_rank": F.col("_n0") + F.row_number().over(inner),
        **{o: F.col(f"_s_{o}") + F.sum(c).over(upto) for o, c in sums.items()},
    }).drop(key, "_bucket", "_n0", *[f"_s_{o}" for o in sums])


def exact_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], group: Sequence[str] = (),
                    buckets: int = BUCKETS) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group that has a value.

    A histogram of the buckets finds those that hold a wanted rank; only their rows are shuffled, counted by
    value and ordered.
    """
    group = list(group)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *group, F.col(value).cast("double").alias("_v"))
    spread = with_bucket(known, "_v", buckets)
    histogram = spread.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    in_group = Window.partitionBy(*group)
    ordered = in_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    positions = histogram.select(
        *group, "_bucket", "_n", F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_before"),
        F.sum("_n").over(in_group).alias("_total"))

    def at(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    wanted = reduce(lambda a, b: a | b, [
        (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))
        for p in probs.values() for rank in (F.floor(at(p)), F.ceil(at(p)))])
    found = positions.where(wanted).drop("_n")
    # without groups this is at most two buckets per quantile
    hit = null_safe(spread, found if group else F.broadcast(found), [*group, "_bucket"])
    counts = hit.groupBy(*group, "_bucket", "_before", "_total", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*group, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding,
                                                                          Window.currentRow)
    ranked = counts.withColumn("_hi", F.col("_before") + F.sum("_c").over(upto)).withColumn(
        "_lo", F.col("_hi") - F.col("_c"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col("_v")))

    picked = ranked.groupBy(*group).agg(
        F.max("_total").alias("_total"),
        *[value_at(F.floor(at(p))).alias(f"_f_{o}") for o, p in probs.items()],
        *[value_at(F.ceil(at(p))).alias(f"_e_{o}") for o, p in probs.items()])
    return picked.select(*group, *[
        (F.col(f"_f_{o}") + (F.col(f"_e_{o}") - F.col(f"_f_{o}")) * (at(p) - F.floor(at(p)))).alias(o)
        for o, p in probs.items()])


def hash_order_rank(df: DataFrame, key: str, group: Sequence[str] = (), lead: Sequence[str] = (),
                    salt: str | None = None, digits: int = 3, rank: str = "rn", total: str = "n") -> DataFrame:
    """``row_number`` in the order ``lead, md5(key), key`` and the group size; ``salt`` is hashed in front.

    The md5 prefix is an even, order-preserving bucket, so each window covers about 16**-digits of a
    group. ``lead`` must be a small domain such as days: its totals are added up in one task per group.
    """
    group, lead = list(group), list(lead)
    text = F.col(key).cast("string")
    if salt is not None:
        text = F.concat(F.col(salt).cast("string"), F.lit("|"), text)
    base = df.withColumn("_md5", F.md5(text)).withColumn("_bucket", F.substring("_md5", 1, digits))
    counts = base.groupBy(*group, *lead, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group, *lead).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, *lead, "_bucket", F.sum("_n").over(earlier).alias("_before"),
                            F.sum("_n").over(Window.partitionBy(*group)).alias(total))
    if lead:
        per_lead = counts.groupBy(*group, *lead).agg(F.sum("_n").alias("_n"))
        ahead = Window.partitionBy(*group).orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)
        starts = per_lead.select(*group, *lead, F.sum("_n").over(ahead).alias("_start"),
                                 F.sum("_n").over(Window.partitionBy(*group)).alias(total))
        offsets = null_safe(offsets.drop(total), starts, [*group, *lead]).withColumn(
            "_before", F.coalesce("_before", F.lit(0)) + F.coalesce("_start", F.lit(0))).drop("_start")
    offsets = offsets.withColumn("_before", F.coalesce("_before", F.lit(0)))
    inner = Window.partitionBy(*group, *lead, "_bucket").orderBy("_md5", key)
    return null_safe(base, offsets, [*group, *lead, "_bucket"]).withColumn(
        rank, F.col("_before") + F.row_number().over(inner)).drop("_md5", "_bucket", "_before")


def one_row(stats: DataFrame) -> Column:
    """A one-row frame as a struct column (scalar subquery): no join, no shuffle of the other side."""
    return stats.select(F.struct("*").alias("_stats")).scalar()
