import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationloom.operators import boost, models


def plain_trees(x, y, asked, trees, rate, depth, least=2):
    """One model by recursion over rows: x holds bins, the last bin is for missing values."""
    pred, out = np.full(len(y), y.mean()), np.full(len(asked), y.mean())

    def grow(rows, at, level, rest):
        value = rest[rows].mean()
        if level == depth:
            return np.full(len(rows), value), np.full(len(at), value)
        best = None
        for f in range(x.shape[1]):
            for b in range(boost.BINS - 1):
                for missing_left in (False, True):
                    go = np.where(x[rows, f] == boost.BINS, missing_left, x[rows, f] <= b)
                    if least <= go.sum() <= len(rows) - least:
                        a, c = rest[rows][go], rest[rows][~go]
                        gain = a.sum() ** 2 / len(a) + c.sum() ** 2 / len(c) - rest[rows].sum() ** 2 / len(rows)
                        if best is None or gain > best[0] * (1 + 1e-9) + 1e-12:
                            best = (gain, f, b, missing_left)
        if best is None or best[0] <= 1e-9:
            return np.full(len(rows), value), np.full(len(at), value)
        _, f, b, missing_left = best
        mine, other = np.empty(len(rows)), np.empty(len(at))
        go, gone = (np.where(t[:, f] == boost.BINS, missing_left, t[:, f] <= b) for t in (x[rows], asked[at]))
        for side in (True, False):
            mine[go == side], other[gone == side] = grow(rows[go == side], at[gone == side], level + 1, rest)
        return mine, other

    for _ in range(trees):
        a, b = grow(np.arange(len(y)), np.arange(len(asked)), 0, y - pred)
        pred, out = pred + rate * a, out + rate * b
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(9)
    n = 90
    pdf = pd.DataFrame({"id": np.arange(n), "g": [f"s{i % 4}" if i % 11 else None for i in range(n)],
                        "a": r.normal(size=n), "b": r.uniform(size=n)})
    pdf.loc[::6, "a"] = np.nan
    pdf["y"] = np.where(pdf.a.isna(), 4.0, pdf.a) + 3 * (pdf.b > 0.5) + r.normal(size=n) * 0.1
    return pdf


def test_equals_a_refit_for_every_group(spark, rows, monkeypatch):
    monkeypatch.setattr(boost, "BLOCK", 2)                      # several blocks of folds
    df = spark.createDataFrame(rows).repartition(3)
    found, importance = boost.boosted_cross_validation(df, ["a", "b"], "y", "g", ["id"], trees=3, rate=0.4, depth=2)
    got = found.toPandas().sort_values("id")
    edges = boost.bin_edges(df.select(F.when(~F.isnan("a"), F.col("a")).alias("a"), "b"), ["a", "b"])
    x = np.stack([np.where(rows[c].isna(), boost.BINS, np.searchsorted(e, rows[c])) for e, c in zip(edges, "ab")], axis=1)
    y, group = rows.y.to_numpy(), rows.g.fillna("none").to_numpy()
    want = np.empty(len(y))
    for g in set(group):
        want[group == g] = plain_trees(x[group != g], y[group != g], x[group == g], 3, 0.4, 2)
    assert len(got) == len(rows) and np.allclose(got.y_pred, want)
    share = {r["feature"]: r["importance"] for r in importance.collect()}
    assert abs(sum(share.values()) - 1) < 1e-9 and min(share.values()) > 0.1


def test_jobs_do_not_grow_with_the_groups(spark, rows):
    counts = []
    for column in ("g", "id"):
        df = spark.createDataFrame(rows)
        spark.sparkContext.setJobGroup(f"boost-{column}", "")
        boost.boosted_cross_validation(df, ["a", "b"], "y", column, trees=1, depth=1)[0].count()
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boost-{column}")))
        spark.sparkContext.setJobGroup("", "")
    assert abs(counts[0] - counts[1]) <= 3 and counts[0] > 0


def test_share_of_rows_and_no_rows(spark, rows):
    df = spark.createDataFrame(rows)
    a, b = (boost.boosted_cross_validation(df.repartition(n), ["a", "b"], "y", "g", ["id"], trees=2, depth=1, share=0.5)[0]
            .toPandas().sort_values("id").y_pred.to_numpy() for n in (1, 3))
    assert np.allclose(a, b)
    assert boost.boosted_cross_validation(df.limit(0), ["a", "b"], "y", "g", trees=1, depth=1)[0].count() == 0


def test_cross_validation_of_boosted_trees_needs_no_fit_a_fold(spark, rows):
    counts = []
    for folds in (2, 6):
        df = spark.createDataFrame(rows.dropna())
        spark.sparkContext.setJobGroup(f"folds-{folds}", "")
        found = models.group_k_fold(df, ["a", "b"], "y", "id", folds, lambda t: models.boosted_trees(t, maxIter=2, maxDepth=2), ["g"])
        assert found.count() == len(rows.dropna()) and found.columns == ["id", "g", "fold", "y_true", "y_pred"]
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds-{folds}")))
        spark.sparkContext.setJobGroup("", "")
    assert abs(counts[0] - counts[1]) <= 3 and counts[0] > 0


def test_cross_validation_grows_the_trees_of_a_boosting(spark, rows):
    """Few values, so the bins cut as Spark ML does: its fit for each fold gives the same predictions."""
    few = rows.assign(a=rows.a.round(0).clip(-1, 1), b=(rows.b * 8).round(0)).dropna(subset=["a"])
    df = spark.createDataFrame(few)

    def make(label):
        return models.boosted_trees(label, maxIter=3, maxDepth=2, subsamplingRate=1.0)

    data = models._labelled(df, ["a", "b"], "y", ["g", "id"]).withColumn("fold", F.col("g"))
    want = {}
    for fold in set(few.g):
        own = F.col("fold").eqNullSafe(F.lit(fold))
        parts = models._fit_and_predict(data.where(~own), data.where(own), ["a", "b"], "y", make, ["id"])
        want |= {r["id"]: r["y_pred"] for r in parts.collect()}
    got = {r["id"]: r["y_pred"] for r in models.leave_one_group_out(df, ["a", "b"], "y", "g", make, ["id"]).collect()}
    assert got.keys() == want.keys()
    assert np.allclose([got[i] for i in sorted(got)], [want[i] for i in sorted(got)])


def test_levels_look_at_places_not_at_rows(spark, monkeypatch):
    monkeypatch.setattr(boost, "ROWS", 1_000)                   # one place lies in several chunks
    n = 6_000
    df = spark.range(n).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 5).cast("double").alias("a"),
                               F.when(F.col("id") % 7 > 0, F.lit(1.0)).alias("b"), (F.col("id") % 5 + F.col("id") % 2).cast("double").alias("y"))
    model = boost.Boosting(df, ["a", "b"], "y", "g", ["id"], boost.Settings(trees=2, depth=2, rate=0.5, share=0.7)).grow()
    sizes = [len(r[0]) // 2 for r in model.chunks.select("x").collect()]
    assert sum(sizes) < n // 50                                 # ten places, a few times where a chunk ends
    got = {r["id"]: r for r in model.held_out().collect()}
    assert sorted(got) == list(range(n)) and all(r["y_true"] == i % 5 + i % 2 and r["g"] == i % 3 for i, r in got.items())
    assert len({(r["g"], i % 5, i % 7 > 0, r["y_pred"]) for i, r in got.items()}) == 30
