import numpy as np
import pytest
from pyspark.sql import functions as F

from stationloom.operators.ranking import exact_quantiles, hash_order_rank, running_sums


@pytest.fixture(scope="module")
def skewed(spark):
    # a third of the rows share one group, and a third of those one value
    return spark.range(9000).select(
        F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 40).cast("int").alias("g"),
        F.when(F.col("id") < 1000, 7.0).otherwise((F.col("id") * 7919 % 1009) / 3).alias("v"), "id").persist()


def test_quantiles_match_numpy_overall_and_per_group(skewed):
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.9, "q4": 1.0}
    data = skewed.toPandas()
    row = exact_quantiles(skewed, "v", probs).first()
    for name, p in probs.items():
        assert row[name] == pytest.approx(np.quantile(data.v, p), abs=1e-9)
    for buckets in (4, 64, 1024):
        for r in exact_quantiles(skewed, "v", {"m": 0.5}, ["g"], buckets).collect():
            assert r["m"] == pytest.approx(np.median(data.v[data.g == r["g"]]), abs=1e-9)


def test_quantiles_of_few_or_no_values(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, float("nan")), (None, 2.0), (None, 4.0)], "g int, v double")
    got = {r["g"]: r["m"] for r in exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == {1: 5.0, None: 3.0}


def test_running_sums_follow_the_order(skewed):
    per = skewed.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    rows = running_sums(per, "v", [], {"total": "n"}, descending=True, buckets=16).toPandas().sort_values("_rank")
    assert list(rows["_rank"]) == list(range(1, len(rows) + 1))
    assert rows.v.is_monotonic_decreasing
    assert list(rows.total) == list(rows.n.cumsum())


def test_hash_rank_numbers_every_group_fully(skewed):
    rows = hash_order_rank(skewed, "id", ["g"]).toPandas()
    for _, part in rows.groupby("g"):
        assert sorted(part.rn) == list(range(1, len(part) + 1)) and (part.n == len(part)).all()
