"""A NaN and a NULL are the same thing everywhere, and no row is lost for want of an order, a group or a feature."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationloom.operators import evaluate, features, integrate, models, normalize, quality, spatial, splits

NAN = float("nan")


@pytest.fixture(scope="module")
def pair(spark):
    """The same rows, with NaN and with NULL."""
    r = np.random.default_rng(1)
    rows = [(i, f"g{i % 3}", float(r.normal()), float(r.normal()), float(r.uniform()), float(r.uniform())) for i in range(60)]
    kinds = "id long, g string, a double, b double, x double, y double"
    with_nan = [row if i % 7 else (*row[:2], NAN, *row[3:]) for i, row in enumerate(rows)]
    with_null = [row if i % 7 else (*row[:2], None, *row[3:]) for i, row in enumerate(rows)]
    return spark.createDataFrame(with_nan, kinds), spark.createDataFrame(with_null, kinds)


CASES = {
    "station_coverage": lambda df: quality.station_coverage(df, "a", "g"),
    "overall_coverage": lambda df: quality.overall_coverage(df, "a", "g"),
    "target_encode": lambda df: features.target_encode(df, "g", "a").drop("a"),
    "scale_minmax": lambda df: features.scale_like(df, df, ["a"], "minmax"),
    "scale_standard": lambda df: features.scale_like(df, df, ["a"], "standard"),
    "ks_distance": lambda df: evaluate.ks_distance(df, "a", F.col("b") > 0, F.col("b") <= 0),
    "quartiles_by": lambda df: evaluate.quartile_groups(df, "a", "b"),
    "quartiles_of": lambda df: evaluate.quartile_groups(df, "b", "a", include_lowest=True),
    "morans_i": lambda df: spatial.morans_i(df, "a", 4),
    "pair_distance_stats": lambda df: spatial.pair_distance_stats(df, df, ["a", "b"]),
    "ols": lambda df: models.ols(df.where("id < 40"), df.where("id >= 40"), ["a", "x"], "b", ["id"])[1],
}


@pytest.mark.parametrize("name", CASES)
def test_nan_is_null(pair, name):
    one, two = (CASES[name](df).toPandas() for df in pair)
    order = list(one.columns)
    one, two = (t.sort_values(order).reset_index(drop=True) for t in (one, two))
    pd.testing.assert_frame_equal(one, two, check_exact=False)
    numbers = one.select_dtypes("number")
    assert len(one) and not (numbers.drop(columns=["a"], errors="ignore").isna().all().any())


def test_rows_without_an_order_are_not_lost(spark):
    df = spark.createDataFrame([("s1", "2020-01-01", 5.0, None), ("s2", "2020-01-01", 1.0, None), ("s2", "2020-01-01", 2.0, 7)],
                               "station_id string, date string, v double, o int")
    got = {r["station_id"]: r["v"] for r in integrate.merge_parts([integrate.Part(df, {"v": "v"}, "o")]).collect()}
    assert got == {"s1": 5.0, "s2": 2.0}


def test_equal_orders_are_told_apart_by_the_rest(spark):
    df = spark.createDataFrame([(1, 1, "b", 2.0), (1, 1, "a", 3.0), (1, 1, "a", 1.0)], "k int, o int, s string, v double")
    for parts in (1, 3):
        assert tuple(normalize.keep_first(df.repartition(parts), ["k"], ["o"]).first()) == (1, 1, "a", 1.0)
        assert tuple(normalize.keep_first(df.repartition(parts), ["k"], ["o"], last=True).first()) == (1, 1, "b", 2.0)


def test_hold_out_by_day_of_a_timestamp(spark):
    df = spark.range(100).withColumn("ts", F.expr("timestamp '2020-01-01' + make_interval(0, 0, 0, 0, cast(id as int) * 6)"))
    held = splits.split_time(df, "id", "ts", 0.2).where("split = 'valid'")
    assert held.count() == 20 and {r["id"] for r in held.collect()} == set(range(80, 100))


def test_search_keeps_all_rows(spark):
    rows = [(i, f"g{i % 6}" if i % 9 else None, float(i % 5) if i % 4 else None, float(i % 5) * 2 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, a double, y double")
    table = models.grid_search(df, ["a"], "y", "g", {"maxDepth": [1, 2]}, folds=2, maxIter=2)
    assert {r["maxDepth"] for r in table.collect()} == {1.0, 2.0} and all(r["rmse"] > 0 for r in table.collect())
    out = models.standardized_model(df, ["a"], "y", "id", maxIter=2)
    assert out.count() == 12 and out.where("y_pred is null").count() == 0


def test_sequential_search_needs_fewer_fits_than_the_grid(spark):
    r = np.random.default_rng(0)
    rows = [(f"g{i % 5}" if i % 9 else None, float(a) if i % 8 else None, float(b), float(3 * a + b + e))
            for i, (a, b, e) in enumerate(r.normal(size=(120, 3)))]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double")
    space = {"regParam": [0.0, 0.01, 0.1, 1.0, 10.0, 100.0]}
    one, two = (models.sequential_search(df, ["a", "b"], "y", "g", space, 5, 3, 3, models.least_squares).toPandas()
                for _ in range(2))
    pd.testing.assert_frame_equal(one, two)
    grid = {}
    for value in space["regParam"]:
        out = models.group_k_fold(df, ["a", "b"], "y", "g", 3, lambda t, v=value: models.least_squares(t, regParam=v))
        grid[value] = evaluate.metrics(out, group=["fold"]).agg(F.avg("rmse")).first()[0]
    whole = one[~one.pruned]
    assert one.folds.sum() < 3 * len(space["regParam"]) and len(one) == 5 and one.regParam.is_unique
    assert all(abs(grid[p] - e) < 1e-9 for p, e in zip(whole.regParam, whole.rmse))
    assert whole.rmse.min() <= 1.05 * min(grid.values())
