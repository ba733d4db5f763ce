import datetime as dt

import pytest
from pyspark.sql import functions as F

from stationloom.functions import scalar
from stationloom.operators import features, filters, integrate, models, normalize, quality
from stationloom.operators.evaluate import fold_summary, metrics
from stationloom.plans import fusion, recipes
from stationloom.plans.evaluation import complete_analysis
from stationloom.sources.spec import GridSpec, SourceSpec

D1, D2, D3 = dt.date(2014, 1, 1), dt.date(2014, 1, 2), dt.date(2014, 9, 2)


@pytest.fixture(scope="module")
def frames(spark):
    obs = spark.createDataFrame([("1", D1, 5.0, 1), ("1", D1, 6.0, 2), ("2", D3, None, 3)],
                                "station_id string, date date, swe double, ord long")
    cswe = spark.createDataFrame([("1", D1, 10.0), ("1", D2, 11.0)], "station_id string, date date, value double")
    terrain = spark.createDataFrame([("1", 90.0, 3.0), ("9", 1.0, 1.0)], "station_id string, aspect double, slope double")
    cover = spark.createDataFrame([("1", 2014, 4.0), ("1", 2015, 5.0)], "station_id string, year int, value double")
    season = spark.createDataFrame([("1", D2, 77.0), ("7", D2, 1.0)], "station_id string, date date, value double")
    return obs, cswe, terrain, cover, season


def test_wide_table_rows_are_the_master_index(frames):
    obs, cswe, terrain, cover, season = frames
    wide = integrate.wide_table({
        "cswe": (SourceSpec("cswe"), cswe), "terrain": (SourceSpec("terrain", "static", ("aspect", "slope")), terrain),
        "cover": (SourceSpec("cover", "yearly"), cover), "scp_start": (SourceSpec("scp_start", "phenology"), season)},
        obs, "ord")
    rows = {(r["station_id"], r["date"]): r for r in wide.collect()}
    assert set(rows) == {("1", D1), ("1", D2), ("2", D3)}
    assert wide.count() == integrate.master_index([obs, cswe]).count()
    assert rows["1", D1]["swe"] == 5.0 and rows["1", D1]["cswe"] == 10.0      # first row of the key is kept
    assert rows["1", D2]["terrain_aspect"] == 90.0 and rows["1", D2]["cover"] == 4.0
    assert rows["1", D2]["scp_start"] == 77.0 and rows["2", D3]["scp_start"] is None
    assert rows["2", D3]["swe"] is None


def test_first_row_is_kept_even_when_its_value_is_missing(spark):
    df = spark.createDataFrame([("1", D1, None, 1), ("1", D1, 3.0, 2)], "station_id string, date date, v double, o int")
    merged = integrate.merge_parts([integrate.Part(df, {"v": "v"}, "o")]).first()
    kept = normalize.keep_first(df, ["station_id", "date"], ["o"]).first()
    assert merged["v"] is None and kept["v"] is None and kept["o"] == 1


def test_altitude_and_coordinates_ride_on_one_station_table(spark, frames):
    obs, cswe, terrain, _, _ = frames
    altitude = spark.createDataFrame([("1", 10.0), ("1", 20.0), ("2", 5.0)], "station_id string, altitude double")
    near = spark.createDataFrame([("1", None, 40.0), ("2", 7.0, 8.0)], "station_id string, longitude double, latitude double")
    far = spark.createDataFrame([("1", 1.0, 2.0), ("2", 9.0, 9.0)], "station_id string, longitude double, latitude double")
    wide = integrate.wide_table({"cswe": (SourceSpec("cswe"), cswe),
                                 "slope": (SourceSpec("slope", "static", ("slope",)), terrain)},
                                obs, "ord", altitude, [near, far])
    rows = {(r["station_id"], r["date"]): r for r in wide.collect()}
    assert len(rows) == 3 and rows["1", D2]["altitude"] == 15.0
    assert (rows["1", D1]["longitude"], rows["1", D1]["latitude"]) == (1.0, 2.0)   # a pair is taken whole
    assert (rows["2", D3]["longitude"], rows["2", D3]["latitude"]) == (7.0, 8.0)


def test_static_only_and_empty(frames):
    obs, cswe, terrain, cover, _ = frames
    out = integrate.wide_table({"terrain": (SourceSpec("terrain", "static", ("aspect", "slope")), terrain),
                                "cover": (SourceSpec("cover", "yearly"), cover)})
    assert {(r["station_id"], r["year"]) for r in out.collect()} == {("1", 2014), ("1", 2015), ("9", None)}
    with pytest.raises(ValueError):
        integrate.wide_table({})


def test_fusion_of_raw_inputs(spark):
    obs = spark.createDataFrame([(1.0, 20140101.0, 5.0), (2.0, 20140902.0, 7.0)], "station_ID double, date double, swe double")
    src = spark.createDataFrame([("1.0", "2014/01/01", 3.5), ("3", "bad", 1.0)], "Station_ID string, date string, value double")
    wide = fusion.fuse({"era5_swe": (SourceSpec("era5_swe"), src)}, obs, station_rule="ids:1,2")
    rows = {r["station_id"]: r for r in wide.collect()}
    assert rows["1"]["era5_swe"] == 3.5 and rows["1"]["hydrological_doy"] == 123
    assert rows["2"]["hydrological_year"] == 2015 and rows["2"]["hydrological_doy"] == 2
    sheets = fusion.reports(wide)
    assert {r["column"]: r["filled"] for r in sheets["fill_rates"].collect()}["swe"] == 2


def test_sampling_masks_and_scales_once(spark):
    grid = GridSpec(0.0, 2.0, 1.0, 1.0, 2, 2)
    cells = spark.createDataFrame([(D1, 0, 0, 100.0), (D1, 0, 1, -9999.0), (D1, 1, 1, -5.0)],
                                  "date date, row int, col int, value double")
    points = spark.createDataFrame([("a", D1, 0.5, 1.5), ("b", D1, 1.5, 1.5), ("c", D1, 1.5, 0.5), ("d", D2, 0.5, 1.5)],
                                   "station_id string, date date, longitude double, latitude double")
    spec = SourceSpec("x", fill=-9999.0, valid_min=0.0, scale=0.1, grid=grid, start="2014-01-01", end="2014-12-31")
    rows = fusion.sample_source(spec, points, cells).collect()
    assert [(r["station_id"], r["value"]) for r in rows] == [("a", pytest.approx(10.0))]


def test_normalisation(spark):
    df = spark.createDataFrame([("12.0", "2014/3/5"), (" 7 ", "2014-03-05"), ("A1", "x"), (None, "20140305")],
                               "Station_ID string, date string")
    rows = normalize.standardize(df).collect()
    assert [(r["station_id"], r["date"]) for r in rows] == [("12", dt.date(2014, 3, 5)), ("7", dt.date(2014, 3, 5)), ("A1", None)]
    taken = spark.createDataFrame([("1", "2")], "Station_ID string, station_id2 string").withColumnRenamed("station_id2", "lon")
    assert normalize.rename_aliases(taken).columns == ["station_id", "longitude"]


def test_impossible_days(spark):
    df = spark.createDataFrame([(2015, 366), (2016, 366), (2015, 0), (None, 1)], "y int, d int")
    got = [r[0] for r in df.select(scalar.year_doy_to_date(F.col("y"), F.col("d"))).collect()]
    assert got == [None, dt.date(2016, 12, 31), None, None]


def test_filters_reject_unknown_rules(spark):
    with pytest.raises(ValueError):
        filters.station_filter(spark.range(1), "region:x")


def test_constant_columns_are_dropped_everywhere(spark):
    train = spark.createDataFrame([(1, 2.0), (1, 3.0)], "a int, b double")
    kept, other = filters.drop_constant_columns(train, ["a", "b"], train)
    assert kept.columns == ["b"] and other.columns == ["b"]


def test_onehot_rows_sum_to_one_or_none(spark):
    df = spark.createDataFrame([(11,), (12,), (None,)], "landuse_code int")
    out = features.one_hot(df, "landuse_code")
    assert {r["row_sum"]: r["records"] for r in quality.onehot_check(out, ["landuse_11", "landuse_12"]).collect()} == {1: 2, 0: 1}
    with pytest.raises(ValueError):
        features.one_hot(spark.range(50), "id", limit=20)


def test_imputation_rules(spark):
    # 2 % missing takes the median, 50 % the mean, text the most frequent
    rows = [(None if i < 2 else float(i), None if i % 2 else float(i * i), "a" if i % 3 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "few double, many double, t string")
    got = features.impute(df, ["few", "many"], ["t"]).toPandas()
    known = [r[0] for r in rows if r[0] is not None]
    assert got.few[0] == pytest.approx(sorted(known)[len(known) // 2 - 1] / 2 + sorted(known)[len(known) // 2] / 2)
    assert got.many[1] == pytest.approx(sum(r[1] for r in rows if r[1] is not None) / 50)
    assert set(got.t) == {"a"}
    empty = spark.createDataFrame([(None,)], "t string")
    assert features.impute(empty, [], ["t"]).first()["t"] == "Unknown"


def test_missing_plan_strategies(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (4.0, "x")], "v double, t string")
    assert features.fit_missing(df, ["v"], ["t"], "mean").replay(df).collect()[1].asDict() == {"v": 2.5, "t": "x"}
    assert features.fit_missing(df, ["v"], [], "drop").training(df).count() == 2
    assert features.fit_missing(df, ["v"], [], "zero").replay(df).collect()[1]["v"] == 0.0


def test_metric_guards(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("c", None, 1.0), ("d", 1.0, 2.0), ("d", 3.0, 5.0)],
                               "fold string, y_true double, y_pred double")
    rows = {r["fold"]: r for r in metrics(df, group=["fold"]).collect()}
    assert rows["a"]["r"] is None and rows["b"]["r"] is None          # one row; constant side
    assert rows["c"]["n"] == 0 and rows["c"]["mae"] is None and rows["c"]["valid_ratio"] == 0
    assert rows["d"]["r"] == pytest.approx(1.0) and rows["d"]["mae"] <= rows["d"]["rmse"]
    summary = {r["metric"]: r for r in fold_summary(metrics(df, group=["fold"])).collect()}
    assert summary["r"]["folds"] == 1 and summary["mae"]["folds"] == 3


def test_recipes_chain_without_writing(spark):
    df = spark.createDataFrame([("1", "2014-01-01", None, "x"), ("1", "2014-01-02", 11, "x"), ("1", "2025-10-11", 11, "x")],
                               "station_id string, date string, landuse_code int, landuse_class string")
    out = recipes.basic_clean_encode().run(df)
    assert out.count() == 2 and "landuse_class" not in out.columns and "landuse_hash_9" in out.columns
    assert out.where("landuse_code is null").count() == 0
    assert recipes.advanced_analysis().summary(df).count() == 3
    assert recipes.quick_fix().run(df).columns == ["station_id", "date", "landuse_code"]
    with pytest.raises(ValueError):
        recipes.Recipe().add("nothing")


RECIPE_ROWS = [("1", "2014-01-01", None, "x", 1.0), ("1", "2014-01-02", 11, "x", float("nan")),
               ("1", "2025-10-11", 11, None, None), (None, "2014-01-01", 4, "x", 2.0), ("2", None, None, "x", 2.0)]
RECIPE_TYPES = "station_id string, date string, landuse_code int, landuse_class string, `a.b` double"


def test_recipe_summaries_count_rows_and_missing_cells(spark, tmp_path):
    df = spark.createDataFrame(RECIPE_ROWS, RECIPE_TYPES)
    plan = recipes.advanced_analysis()
    runs, written = [], tmp_path / "out"
    observed = plan.observed(df, lambda out: (runs.append(1), out.write.parquet(str(written)))).orderBy("position").collect()
    # input: station, date, two codes, class, NaN and NULL; the fixer drops a row and a column and fills one code
    assert [(r["step"], r["columns"], r["rows"], r["missing"]) for r in observed] == [
        ("input", 5, 5, 7), ("data_analyzer", 5, 5, 7), ("data_fixer", 4, 4, 4), ("feature_encoder", 15, 4, 5)]
    assert len(runs) == 1 and spark.read.parquet(str(written)).count() == 4 and all(r["seconds"] >= 0 for r in observed)
    out, staged = plan.staged(df, str(tmp_path / "steps"))
    assert [(r["step"], r["rows"], r["missing"]) for r in staged.orderBy("position").collect()] == [
        (r["step"], r["rows"], r["missing"]) for r in observed[1:]]
    assert sorted(map(str, out.collect())) == sorted(map(str, plan.run(df).collect()))
    assert spark.read.parquet(str(tmp_path / "steps" / "02_data_fixer")).count() == 4
    empty = plan.observed(df.limit(0), lambda out: out.write.format("noop").mode("overwrite").save())
    assert {(r["rows"], r["missing"]) for r in empty.collect()} == {(0, 0)}


def test_recipe_reports(spark):
    found = recipes.advanced_analysis().reports(spark.createDataFrame(RECIPE_ROWS, RECIPE_TYPES))
    assert sorted(found) == [f"1_data_analyzer/{r}" for r in (
        "class_distribution", "encoding_advice", "repair_preview", "station_consistency")]
    preview = found["1_data_analyzer/repair_preview"].first()
    assert tuple(preview) == (5, 2, 1, "landuse_class")
    classes = {(r["column"], r["class"]): (r["records"], r["pct"]) for r in found["1_data_analyzer/class_distribution"].collect()}
    assert classes == {("landuse_code", None): (2, 40.0), ("landuse_code", "11"): (2, 40.0), ("landuse_code", "4"): (1, 20.0),
                       ("landuse_class", "x"): (4, 80.0), ("landuse_class", None): (1, 20.0)}
    assert recipes.quick_fix().reports(spark.createDataFrame(RECIPE_ROWS, RECIPE_TYPES)) == {}


def test_every_row_is_predicted_once_by_a_model_without_its_group(spark):
    df = spark.range(120).select((F.col("id") % 6).alias("g"), F.col("id").cast("double").alias("x"),
                                 (F.col("id") * 2.0).alias("y"))
    make = lambda label: models.boosted_trees(label, maxIter=2, maxDepth=2)
    for out, count in ((models.leave_one_group_out(df, ["x"], "y", "g", make), 6),
                       (models.group_k_fold(df, ["x"], "y", "g", 3, make), 3)):
        assert out.count() == 120 and out.select("fold").distinct().count() == count
        assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def _holed(spark):
    """NULL and NaN features, NULL groups, unlabelled rows."""
    k = F.col("id")
    return spark.range(60).select(
        k, F.when(k % 7 != 0, k % 5).alias("g"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, float("nan")).otherwise(k.cast("double")).alias("x"),
        (k * k % 11).cast("double").alias("z"), F.when(k % 10 != 9, k * 2.0).alias("y"))


def test_no_labelled_row_is_lost(spark):
    df = _holed(spark)
    make = lambda label: models.boosted_trees(label, maxIter=2, maxDepth=2)
    want = sorted(r["id"] for r in df.where("y is not null").collect())
    for out in (models.leave_one_group_out(df, ["x", "z"], "y", "g", make, ["id"]),
                models.group_k_fold(df, ["x", "z"], "y", "g", 3, make, ["id"]),
                models.leave_one_group_out_ols(df, ["x", "z"], "y", "g", ["id"])):
        assert sorted(r["id"] for r in out.collect()) == want
        assert out.where("y_pred is null").count() == 0


def test_least_squares_folds_equal_refitting(spark):
    import numpy as np

    rows = [r for r in _holed(spark).collect() if r["y"] is not None]
    x = np.array([[np.nan if r["x"] is None else r["x"], r["z"]] for r in rows])
    y = np.array([r["y"] for r in rows])
    want = {}
    for g in {r["g"] for r in rows}:
        held = np.array([r["g"] == g for r in rows])
        fill = np.nanmean(x[~held], axis=0)
        full = np.column_stack([np.where(np.isnan(x), fill, x), np.ones(len(x))])
        w = np.linalg.lstsq(full[~held], y[~held], rcond=None)[0]
        want |= {rows[i]["id"]: full[i] @ w for i in np.nonzero(held)[0]}
    got = {r["id"]: r["y_pred"] for r in models.leave_one_group_out_ols(_holed(spark), ["x", "z"], "y", "g", ["id"]).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_rows_of_unseen_clusters_stay(spark):
    train = spark.range(40).select((F.col("id") % 2).alias("c"), F.col("id").cast("double").alias("x"), (F.col("id") * 1.0).alias("y"))
    test = spark.range(20).select(F.when(F.col("id") % 4 != 3, F.col("id") % 4).alias("c"), F.when(
        F.col("id") % 5 != 0, F.col("id").cast("double")).alias("x"), (F.col("id") * 1.0).alias("y"))
    out = models.forest_per_cluster(train, test, ["x"], "y", "c", numTrees=2, maxDepth=2)
    assert out.count() == 20
    assert out.where("y_pred is null").count() == out.where("c is null or c = 2").count() == 10


def test_complete_analysis_tables(spark):
    df = spark.range(90).select((F.col("id") % 3).cast("string").alias("station_id"),
                                F.date_add(F.lit("2013-06-01").cast("date"), (F.col("id") * 9).cast("int")).alias("date"),
                                (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 * 3.0).alias("swe"))
    make = lambda label: models.boosted_trees(label, maxIter=2, maxDepth=2)
    tables = complete_analysis(df, ["a"], products=["a"], make=make)
    assert {r["scheme"] for r in tables["overall"].collect()} == {"station", "yearly"}
    assert tables["comparison"].count() == 1 and tables["products"].first()["n"] == 90
    assert tables["importance"].first()["importance"] == pytest.approx(1.0)


def test_duplicate_groups_are_numbered_in_key_order(spark):
    rows = [("b", D1, 1), ("b", D1, 2), ("a", D2, 3), ("a", D2, 4), ("a", D1, 5), ("a", D1, 6), ("c", D1, 7)]
    df = spark.createDataFrame(rows, "station_id string, date date, ord int")
    got = {r["ord"]: (r["copies"], r["duplicate_group"]) for r in quality.duplicate_rows(df).collect()}
    assert got == {5: (2, 0), 6: (2, 0), 3: (2, 1), 4: (2, 1), 1: (2, 2), 2: (2, 2)}


def test_column_weights_leave_other_columns_alone(spark):
    df = spark.createDataFrame([(2.0, 3.0, None), (2.0, 3.0, 4.0)], "a double, b double, w double")
    out = df.withColumns(scalar.weight_columns(["a", "b"], {"a": F.col("w")})).collect()
    assert [(r["a"], r["b"]) for r in out] == [(2.0, 3.0), (8.0, 3.0)]
