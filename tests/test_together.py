"""Independent models of one analysis run at the same time: each waits here until the others have begun."""

import threading

import pytest

from stationloom.operators import models
from stationloom.plans import evaluation


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(f"s{i % 4}", f"20{10 + i % 3}-01-01", float(i % 7), float(i)) for i in range(24)],
                                 "station_id string, date string, a double, swe double")


def waits_for(spark, number):
    meeting = threading.Barrier(number)

    def found(df, features, label, group, *args, **kwargs):
        meeting.wait(20)                # broken, so an error, where one comes after the other
        return spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, 3.0), (1, 4.0, 4.0)], "fold int, y_true double, y_pred double")

    return found


def test_settings_of_a_grid(spark, rows, monkeypatch):
    monkeypatch.setattr(models, "group_k_fold", waits_for(spark, 2))
    got = models.grid_search(rows, ["a"], "swe", "station_id", {"maxDepth": [5, 3]}, folds=2).collect()
    assert [r["maxDepth"] for r in got] == [5.0, 3.0] and all(abs(r["rmse"] - 0.5 ** 0.5 / 2) < 1e-9 for r in got)


def test_both_sides_of_an_ablation(spark, rows, monkeypatch):
    monkeypatch.setattr(models, "cross_validated", waits_for(spark, 2))
    got = models.ablation(rows, rows, ["a"], "swe", "station_id").collect()
    assert sorted((r["model"], r["scheme"], r["n"]) for r in got) == [("base", "station_id", 3), ("weighted", "station_id", 3)]


def test_schemes_of_a_complete_analysis(spark, rows, monkeypatch):
    monkeypatch.setattr(models, "cross_validated", waits_for(spark, 2))
    dated = rows.withColumn("date", rows["date"].cast("date"))
    out = evaluation.complete_analysis(dated, ["a"], make=lambda label: models.boosted_trees(label, maxIter=1, maxDepth=1))
    assert sorted((r["scheme"], r["n"]) for r in out["overall"].collect()) == [("station", 3), ("yearly", 3)]
    assert [r["feature"] for r in out["importance"].collect()] == ["a"]
