import datetime as dt

import pytest
from pyspark.sql import functions as F

from stationloom.operators import sampling
from stationloom.sources import readers, writers
from stationloom.sources.spec import DEFAULTS, GridSpec, SourceSpec, infer_kind

GRID_TEXT = """ncols 4
nrows 3
xllcenter 60
yllcenter 15
cellsize 0.25
NODATA_value -1
1 2 3 4
5 -1 7 8
9 10 11 12
"""


def test_ascii_grids_from_files(spark, tmp_path):
    (tmp_path / "20140131.txt").write_text(GRID_TEXT)
    (tmp_path / "20140201.txt").write_text(GRID_TEXT.replace("12", "13"))
    cells = readers.read_ascii_grids(spark, str(tmp_path))
    rows = {(r["date"], r["row"], r["col"]): r for r in cells.collect()}
    assert len(rows) == 24
    day = dt.date(2014, 1, 31)
    assert rows[day, 0, 0]["value"] == 1 and rows[day, 0, 0]["y"] == 15.5 and rows[day, 0, 0]["x"] == 60
    assert rows[day, 1, 1]["value"] is None
    assert rows[dt.date(2014, 2, 1), 2, 3]["value"] == 13 and rows[day, 2, 3]["file_used"] == "20140131.txt"


def test_grid_edges(spark):
    grid = GridSpec(60.0, 15.75, 0.25, 0.25, 3, 4)
    at = [(60.0, 15.75, 0, 0), (60.24, 15.51, 0, 0), (60.25, 15.5, 0 + 1, 1), (60.99, 15.01, 2, 3)]
    outside = [(59.9, 15.6), (61.0, 15.6), (60.1, 15.76), (60.1, 15.0)]
    df = spark.createDataFrame([(x, y) for x, y, *_ in at] + outside, "longitude double, latitude double")
    got = {(r["longitude"], r["latitude"]): (r["row"], r["col"]) for r in sampling.locate(df, grid).collect()}
    assert got == {(x, y): (row, col) for x, y, row, col in at}


def test_centre_origin_moves_the_corner():
    grid = DEFAULTS["snow_depth"].grid
    assert grid.west == pytest.approx(59.875) and grid.north == pytest.approx(55.125)


def test_delimited_encodings(spark, tmp_path):
    for encoding, name in (("utf-8", "积雪"), ("gbk", "积雪"), ("latin1", "é")):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes(f"station_id,name\n1,{name}\n".encode(encoding))
        row = readers.read_delimited(spark, str(path), encoding=encoding).first()
        assert row["name"] == name and row["station_id"] == 1


def test_both_sinks_and_sheets(spark, tmp_path):
    df = spark.createDataFrame([("1", dt.date(2014, 1, 1), 2.0)], "station_id string, date date, value double")
    parquet, csv = writers.write_both(df, str(tmp_path), "cswe", "2014-01-01", "2014-12-31", ["date"])
    assert parquet.endswith("cswe_20140101_20141231.parquet")
    assert readers.read_parquet(spark, parquet, ["station_id", "value"]).first()["value"] == 2.0
    assert spark.read.option("header", True).csv(csv).count() == 1
    paths = writers.write_sheets({"a": df, "b": df.groupBy("station_id").count()}, str(tmp_path / "sheets"))
    assert spark.read.option("header", True).csv(paths["b"]).first()["count"] == "1"
    writers.write_sorted(df, str(tmp_path / "sorted"), files=2)
    out = writers.write_evaluation(df, df, df, df, str(tmp_path / "evaluation"))
    assert spark.read.json(out["summary"]).count() == 1


def test_pushdown_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "stations")
    spark.range(100).select(F.col("id").alias("station_id"), F.date_add(F.lit("2014-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                            F.rand().alias("swe"), F.rand().alias("other")).write.parquet(path)
    plan = readers.station_scan(spark.read.parquet(path), ["station_id", "swe"], "date", "2014-02-01", "2014-03-01")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in text and "other" not in text.split("ReadSchema")[1]
    assert plan.count() == 29


def test_file_names(spark):
    names = ["20130102_northern.nc", "F17_SSMIS_SWE_20130102_DAILY_025KM_V1.2.h5", "depth_2013-01-02.txt", "none.txt",
             "20139999.txt"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    rows = df.select(readers.file_date(F.col("f")), readers.file_sensor(F.col("f"), ["F17_SSMIS"])).collect()
    day = dt.date(2013, 1, 2)
    assert [r[0] for r in rows] == [day, day, day, None, None]
    assert [r[1] for r in rows] == [None, "F17_SSMIS", None, None, None]


def test_kinds(spark):
    dated = spark.createDataFrame([(str(i % 2), dt.date(2014, 1, 1), 1.0) for i in range(20)],
                                  "station_id string, date date, value double")
    assert infer_kind(dated) == "dynamic"
    assert infer_kind(dated.limit(2)) == "dynamic"
    assert infer_kind(dated.withColumnRenamed("date", "year")) == "yearly"
    assert infer_kind(dated, "GLDAS_daily") == "gldas"
    assert infer_kind(dated.drop("date")) == "static"
    season = dated.withColumns({"dataset_type": F.lit("start"), "hydrological_year": F.lit(2014)})
    assert infer_kind(season) == "phenology" and infer_kind(dated, "scp") == "phenology"
    assert infer_kind(dated, "landcover") == "yearly" and infer_kind(dated, "terrain_features") == "static"
    with pytest.raises(ValueError):
        SourceSpec("x", kind="other")


def test_published_outputs_come_together_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "results")
    rows = [("a", 1.5, "say \"hi\", then go"), ("b", None, ""), (None, float("nan"), None)]
    first = spark.createDataFrame(rows, "id string, value double, note string")
    with pytest.raises(ValueError):
        writers.read_published(spark, folder, "one")
    assert writers.published_names(spark, folder) == []
    writers.publish({f: writers.Output(first, f) for f in ("parquet", "csv", "json", "orc")}, folder, spark)
    wanted = sorted(map(str, first.collect()))
    for name in writers.published_names(spark, folder):
        back = writers.read_published(spark, folder, name)
        assert back.schema == first.schema and sorted(map(str, back.collect())) == wanted, name
    # the second output fails while it is written: the first one does not appear, and the old version stays
    broken = first.select(F.raise_error("no luck").cast("string").alias("id"))
    with pytest.raises(Exception, match="no luck"):
        writers.publish({"csv": writers.Output(first.limit(1), "csv"), "two": writers.Output(broken)}, folder, spark)
    assert len(writers.published_names(spark, folder)) == 4
    assert writers.read_published(spark, folder, "csv").count() == 3
    assert len(list((tmp_path / "results" / "versions").iterdir())) == 1
    # a partitioned output keeps its column order, and a new version replaces the one before
    writers.publish({"one": writers.Output(first, partition_by=("id",))}, folder, spark)
    assert writers.published_names(spark, folder) == ["one"]
    assert writers.read_published(spark, folder, "one").columns == first.columns
    assert sorted(map(str, writers.read_published(spark, folder, "one").collect())) == wanted
