"""Stand-in views over the given tables, in Spark and in SQL, and the query registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationloom.sources.spec import GridSpec

GRID = GridSpec(73.0, 53.0, 1.25, 0.9, 40, 50)


class Views:
    """Station-like frames over one folder of the given tables. Whole tables, no subsets."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._tables = spark, folder.rstrip("/"), {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def obs(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").cast("string").alias("station_id"),
            F.add_months(F.col("o_orderdate").cast("date"), 192).alias("date"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 1000).alias("swe"),
            F.col("o_orderkey").alias("ord"))

    @cached_property
    def station(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.cast("string").alias("station_id"), k.alias("num"),
            (73 + (k * 37 % 6200) / F.lit(100.0).cast("double")).alias("lon"),
            (18 + (k * 53 % 3500) / F.lit(100.0).cast("double")).alias("lat"),
            F.col("c_acctbal").alias("altitude"), (11 + F.col("c_nationkey")).cast("bigint").alias("landuse_code"),
            F.col("c_mktsegment").alias("zone"))

    @cached_property
    def terrain(self) -> DataFrame:
        k = F.col("c_custkey")
        known = k % 11 != 0
        return self.table("customer").select(
            k.cast("string").alias("station_id"), F.when(known, (k * 17 % 360).cast("double")).alias("aspect"),
            F.when(known, (k * 13 % 60).cast("double")).alias("slope"))

    @cached_property
    def dyn_cswe(self) -> DataFrame:
        joined = self.table("lineitem").select("l_orderkey", "l_quantity").join(
            self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"),
            F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("d")).agg(
            (F.avg("l_quantity") * 5).alias("value")).select(
            F.col("o_custkey").cast("string").alias("station_id"), F.add_months("d", 192).alias("date"), "value")

    @cached_property
    def dyn_temp(self) -> DataFrame:
        joined = self.table("lineitem").select("l_orderkey", "l_extendedprice").join(
            self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"),
            F.col("l_orderkey") == F.col("o_orderkey"))
        d = F.add_months(F.col("o_orderdate").cast("date"), 192)
        return joined.groupBy(F.col("o_custkey").cast("string").alias("station_id"), F.year(d).alias("year"),
                              F.month(d).alias("month")).agg(F.avg("l_extendedprice").alias("value"))

    @cached_property
    def phen(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").cast("string").alias("station_id"), F.col("ts").cast("date").alias("date"),
            F.col("event_type").alias("dataset_type"), "value", "event_id")

    @cached_property
    def cells(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            F.floor(k / 2000).cast("int").alias("layer"), F.floor(k % 2000 / 50).cast("int").alias("row"),
            (k % 50).cast("int").alias("col"), F.when(F.col("p_size") != 1, F.col("p_retailprice")).alias("value"),
            k.alias("cell_id"))

    @cached_property
    def pred(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500).alias("y_pred"),
            F.col("l_suppkey").alias("fold"), F.year("l_shipdate").cast("bigint").alias("yr"), "l_quantity",
            "l_discount", "l_tax")

    @cached_property
    def weights(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("weights"),
            F.col("label").cast("bigint").alias("label"))

    @cached_property
    def classes(self) -> DataFrame:
        return self.table("nation").select(
            (11 + F.col("n_nationkey")).cast("bigint").alias("code"), F.col("n_name").alias("label"))


DATE = "cast(cast(o_orderdate as date) + interval 16 year as date)"
VIEW_SQL = {
    "obs": f"""select cast(o_custkey as varchar) station_id, {DATE} as date,
        case when o_orderstatus = 'P' then null else o_totalprice/1000 end swe, o_orderkey ord from orders""",
    "station": """select cast(c_custkey as varchar) station_id, c_custkey num,
        73 + (c_custkey*37 % 6200)/cast(100 as double) lon, 18 + (c_custkey*53 % 3500)/cast(100 as double) lat,
        c_acctbal altitude, cast(11 + c_nationkey as bigint) landuse_code, c_mktsegment as zone from customer""",
    "terrain": """select cast(c_custkey as varchar) station_id,
        case when c_custkey % 11 = 0 then null else cast(c_custkey*17 % 360 as double) end aspect,
        case when c_custkey % 11 = 0 then null else cast(c_custkey*13 % 60 as double) end slope from customer""",
    "dyn_cswe": f"""select cast(o_custkey as varchar) station_id, {DATE} as date, avg(l_quantity)*5 as value
        from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""",
    "dyn_temp": f"""select cast(o_custkey as varchar) station_id, year({DATE}) as year, month({DATE}) as month,
        avg(l_extendedprice) as value from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3""",
    "phen": """select cast(user_id as varchar) station_id, cast(ts as date) as date, event_type dataset_type, value,
        event_id from events""",
    "cells": """select cast(floor(p_partkey/2000.0) as bigint) as layer,
        cast(floor((p_partkey % 2000)/50.0) as bigint) as row_, cast(p_partkey % 50 as bigint) as col_,
        case when p_size = 1 then null else p_retailprice end as value, p_partkey cell_id from part""",
    "pred": """select l_extendedprice y_true, l_quantity*1500 y_pred, l_suppkey fold, year(l_shipdate) yr,
        l_quantity, l_discount, l_tax from lineitem""",
    "weights": """select vec_id id, cast(embedding as double[]) as weights,
        cast(label as bigint) as label from embeddings""",
    "classes": "select cast(11 + n_nationkey as bigint) as code, n_name as label from nation",
}


def with_views(sql: str) -> str:
    """Prepend the views a statement names."""
    used = [n for n in VIEW_SQL if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    heads = ", ".join(f"{n} as ({VIEW_SQL[n]})" for n in used)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {heads}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {heads}, {body[5:]}"
    return f"with {heads} {body}"


@dataclass(frozen=True)
class Case:
    build: Callable[[Views], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in CASES:
            raise ValueError(f"query {name} is registered twice")
        CASES[name] = Case(fn, None if sql is None else with_views(sql))
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def settle(df: DataFrame) -> DataFrame:
    """One integer and one floating type, so both engines report the same schema."""
    plan = {}
    for name, kind in df.dtypes:
        if kind in ("int", "smallint", "tinyint"):
            plan[name] = F.col(name).cast("bigint")
        elif kind == "float" or kind.startswith("decimal"):
            plan[name] = F.col(name).cast("double")
    return df.withColumns(plan) if plan else df
