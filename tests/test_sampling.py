import pytest
from pyspark.sql import functions as F

from stationloom.operators import sampling
from stationloom.sources.spec import GridSpec

GRID = GridSpec(0.0, 4.0, 1.0, 1.0, 4, 5, "centre")


@pytest.mark.parametrize("sample", [sampling.sample_affine, sampling.sample_axis])
def test_all_layers_of_an_address_by_a_hash_join(spark, sample):
    points = spark.createDataFrame([(i, 0.3 + i % 5, 3.8 - i % 4) for i in range(40)] + [(40, None, 1.0), (1, 1.3, 2.8)],
                                   "id long, x double, y double")
    cells = spark.createDataFrame([(k, r, c, float(k + r)) for k in range(6) for r in range(4) for c in range(5) if r != 3] + [
        (0, None, 1, 9.0), (0, 1, 1, None), (0, 1, 1, None)], "layer int, row int, col int, value double")
    names = {sampling.sample_affine: ("lon", "lat"), sampling.sample_axis: ("x", "y")}[sample]
    found = sample(points, cells, GRID, (), **dict(zip(names, "xy")))
    placed = sample(points, cells.select("row", "col").distinct(), GRID, (), **dict(zip(names, "xy"))).collect()
    have = [tuple(c) for c in cells.collect()]
    want = sorted(((p.id, p.row, p.col, k, v) for p in placed for k, r, c, v in have if (r, c) == (p.row, p.col)), key=repr)
    assert sorted(map(tuple, found.select("id", "row", "col", "layer", "value").collect()), key=repr) == want and len(want) > 150
    assert "ShuffledHashJoin" in found._jdf.queryExecution().toString()
    # dated cells are one for each key: the choice stays with Spark
    dated = sample(points.withColumn("date", F.lit(1)), cells.withColumn("date", F.lit(1)), GRID, ("date",), **dict(zip(names, "xy")))
    assert "ShuffledHashJoin" not in dated._jdf.queryExecution().toString()
