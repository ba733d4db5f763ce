"""Training splits in a repeatable hash order; ranks run over keys in even buckets, never over one window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom.operators.ranking import hash_order_rank


def _whole(fraction: float) -> Column:
    return F.floor(F.col("n") * F.lit(float(fraction)).cast("double"))


def split_stations(df: DataFrame, station: str = "station_id", test: float = 0.15, valid: float = 0.10) -> DataFrame:
    """``station, split`` with 75/10/15 train/valid/test shares of the stations."""
    ranked = hash_order_rank(df.select(station).distinct(), station)
    train_end = _whole(1 - test - valid)
    return ranked.select(station, F.when(F.col("rn") <= train_end, "train").when(
        F.col("rn") <= train_end + _whole(valid), "valid").otherwise("test").alias("split"))


def hold_out_stations(df: DataFrame, share: float = 0.10, station: str = "station_id") -> DataFrame:
    ranked = hash_order_rank(df.select(station).distinct(), station)
    return ranked.select(station, F.when(F.col("rn") <= _whole(share), "test").otherwise("train").alias("split"))


def split_clusters(stations: DataFrame, cluster: str = "cluster", station: str = "station_id", small: int = 10,
                   salt: str | None = None) -> DataFrame:
    """10/10/80 test/valid/train inside every cluster; clusters under ``small`` go to train."""
    group = [cluster] if salt is None else [salt, cluster]
    ranked = hash_order_rank(stations.select(*group, station).distinct(), station, group=group, salt=salt)
    split = F.when(F.col("n") < small, "train").when(F.col("rn") <= _whole(0.1), "test").when(
        F.col("rn") <= _whole(0.2), "valid").otherwise("train")
    return ranked.select(*group, station, split.alias("split"))


def repeated_splits(stations: DataFrame, runs: int = 10, cluster: str = "cluster", station: str = "station_id"
                    ) -> DataFrame:
    """``run, cluster, station, split`` of independent resamples of the station table (not of its rows)."""
    many = stations.select(cluster, station).distinct().withColumn(
        "run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    return split_clusters(many, cluster, station, salt="run")


def split_time(df: DataFrame, key: str, date: str = "date", share: float = 0.2, last: bool = True) -> DataFrame:
    """The last (or first) share of the rows in date order is for validation; ties within a day by hash.

    Days are few, so their row counts are added up first; only equal days are ordered further.
    """
    ranked = hash_order_rank(df.withColumn("_day", F.to_date(date)), key, lead=["_day"], digits=2)
    held = F.col("rn") > F.col("n") - _whole(share) if last else F.col("rn") <= _whole(share)
    return ranked.withColumn("split", F.when(held, "valid").otherwise("train")).drop("rn", "n", "_day")


def split_zones(df: DataFrame, zone: str = "zone", share: float = 0.2) -> DataFrame:
    """A share of the zones is held out whole."""
    ranked = hash_order_rank(df.select(zone).distinct(), zone)
    return ranked.select(zone, F.when(F.col("rn") <= _whole(share), "test").otherwise("train").alias("split"))


def group_folds(df: DataFrame, group: str = "station_id", folds: int = 5) -> DataFrame:
    """``group, fold``: groups dealt round-robin in hash order."""
    ranked = hash_order_rank(df.select(group).distinct(), group)
    return ranked.select(group, F.pmod(F.col("rn") - 1, F.lit(folds)).alias("fold"))


def attach_split(df: DataFrame, split: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(split, list(keys))
