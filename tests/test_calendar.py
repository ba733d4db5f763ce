import datetime as dt

import pytest
from pyspark.sql import functions as F

from stationloom.functions import calendar as cal

# date, fixed-offset day, exact day, end-year label
VECTORS = [
    ("2013-09-01", 1, 1, 2014), ("2013-12-31", 122, 122, 2014), ("2014-01-01", 123, 123, 2014),
    ("2014-08-31", 365, 365, 2014), ("2016-08-31", 366, 366, 2016), ("2016-09-01", 2, 1, 2017),
    ("2013-09-22", 22, 22, 2014), ("2013-12-21", 112, 112, 2014), ("2014-03-20", 201, 201, 2014),
    ("2014-06-21", 294, 294, 2014), ("2016-12-21", 113, 112, 2017), ("2013-10-01", 31, 31, 2014),
]


def test_season_days_and_labels(spark):
    df = spark.createDataFrame([(v[0],) for v in VECTORS], "d string").withColumn("d", F.col("d").cast("date"))
    d = F.col("d")
    rows = df.select(d.cast("string"), cal.hydro_doy_fixed(d), cal.hydro_doy(d), cal.hydro_year(d)).collect()
    assert [tuple(r) for r in rows] == VECTORS


def test_exact_day_equals_days_since_september(spark):
    df = spark.range(3000).select(F.date_add(F.lit("2011-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    start = F.make_date(cal.hydro_year(F.col("d")) - 1, F.lit(9), F.lit(1))
    assert df.where(cal.hydro_doy(F.col("d")) != F.datediff("d", start) + 1).count() == 0


def test_natural_day_vectors(spark):
    df = spark.createDataFrame([(244,), (365,), (1,), (243,)], "n int")
    assert [r[0] for r in df.select(cal.hydro_doy_from_natural(F.col("n"))).collect()] == [365, 121, 122, 364]


def test_unknown_dates_stay_unknown(spark):
    df = spark.createDataFrame([(None,)], "date date")
    row = cal.with_event_distances(df).first()
    assert row["hydrological_doy"] is None and row["nearest_solstice_equinox"] is None


def test_nearest_event_on_its_day(spark):
    df = spark.createDataFrame([(dt.date(2014, 3, 20),), (dt.date(2030, 1, 1),)], "date date")
    near, far = cal.with_event_distances(df).orderBy("date").collect()
    assert near["nearest_solstice_equinox"] == "spring_equinox"
    assert near["distance_to_nearest_solstice_equinox"] == 0
    assert far["distance_to_nearest_solstice_equinox"] is None


def test_parity_lookup_uses_next_season(spark):
    exact = {r[0]: r for r in cal.event_table(spark).collect()}
    shifted = {r[0]: r for r in cal.event_table(spark, parity=True).collect()}
    assert exact[2014]["autumn_equinox"] == dt.date(2013, 9, 22)
    assert shifted[2014]["autumn_equinox"] == dt.date(2014, 9, 23)


def test_inverse_distances_of_season_days(spark):
    years = [2014, 2014, 2015, 2015, 2016, 2016, 2017, 2017, 2014, 2015]
    days = [1, 100, 200, 300, 50, 150, 250, 350, 91, 182]
    df = spark.createDataFrame(list(zip(range(10), years, days)),
                               "i int, hydrological_year int, hydrological_doy int")
    rows = cal.with_inverse_event_distances(df).orderBy("i").collect()
    assert rows[0]["inverse_dist_autumn_equinox"] == pytest.approx(1 / 21)   # 22 September is day 22
    assert rows[1]["inverse_dist_winter_solstice"] == pytest.approx(1 / 12)  # 21 December is day 112
    assert all(0 < r[c] <= 1 for r in rows for c in r.asDict() if c.startswith("inverse"))


def test_inverse_distance_outside_range(spark):
    df = spark.createDataFrame([(2014, 0), (2014, 367), (1990, 5)], "hydrological_year int, hydrological_doy int")
    assert all(r["inverse_dist_autumn_equinox"] is None
               for r in cal.with_inverse_event_distances(df).collect())
