import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationloom.operators import cells, sampling, spatial
from stationloom.operators.evaluate import correlation_p


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(3)
    dense = r.normal(0, 0.01, (150, 2))           # a third of the points in one spot
    same = np.tile([[5.0, 5.0]], (60, 1))         # and many at one position
    wide = r.uniform(-20, 20, (290, 2))
    xy = np.r_[dense, same, wide]
    pdf = pd.DataFrame(xy, columns=["x", "y"])
    pdf["id"], pdf["v"] = np.arange(len(pdf)), r.normal(size=len(pdf)) + xy[:, 0]
    return spark.createDataFrame(pdf).persist(), pdf


def distances(pdf):
    xy = pdf[["x", "y"]].to_numpy()
    return np.sqrt(((xy[:, None] - xy) ** 2).sum(-1))


@pytest.mark.parametrize("target", [40, 2000])
def test_knn_equals_brute_force(points, target):
    df, pdf = points
    d = distances(pdf)
    got = spatial.knn(df, 8, target=target).toPandas()
    assert len(got) == 8 * len(pdf)
    for i, part in got.groupby("id"):
        row = d[i].copy()
        row[i] = np.inf
        want = np.lexsort((np.arange(len(row)), row))[:8]
        assert list(part.sort_values("rank").neighbor) == list(want)


def test_knn_with_fewer_points_than_k(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 5.0, 0.0)], "id long, x double, y double")
    got = {(r["id"], r["neighbor"]) for r in spatial.knn(df, 8).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


def test_busy_cells_are_split_on_both_sides(points, monkeypatch):
    df, pdf = points
    monkeypatch.setattr(cells, "ASKED", 7)
    monkeypatch.setattr(cells, "HELD", 11)
    got = spatial.knn(df, 3, target=30).toPandas()
    want = np.sort(np.where(np.eye(len(pdf)) > 0, np.inf, distances(pdf)), axis=1)[:, :3]
    assert np.allclose(got.sort_values(["id", "rank"]).distance.to_numpy().reshape(-1, 3), want)


def test_morans_i_equals_matrix_form(points):
    df, pdf = points
    n, k = len(pdf), 8
    w = np.zeros((n, n))
    for i, part in spatial.knn(df, k, target=60).toPandas().groupby("id"):
        w[i, part.neighbor] = 1 / k
    z = (pdf.v - pdf.v.mean()).to_numpy()
    s0, s1 = w.sum(), 0.5 * ((w + w.T) ** 2).sum()
    s2 = ((w.sum(1) + w.sum(0)) ** 2).sum()
    ei = -1 / (n - 1)
    vi = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - ei ** 2
    row = spatial.with_normal_p(spatial.morans_i(df, "v", k, target=60)).first()
    assert row["i"] == pytest.approx(n / s0 * (z @ w @ z) / (z @ z))
    assert row["vi"] == pytest.approx(vi)
    assert 0 <= row["p_norm"] <= 1


def test_gwr_equals_full_weights(points):
    df, pdf = points
    d, bandwidth = distances(pdf), 2.0
    a = np.c_[np.ones(len(pdf)), pdf.v]
    target = (pdf.x + pdf.y).to_numpy()
    want = []
    for i in range(len(pdf)):
        w = np.exp(-0.5 * (d[i] / bandwidth) ** 2)
        want.append(a[i] @ np.linalg.solve((a.T * w) @ a, (a.T * w) @ target))
    data = df.withColumn("t", F.col("x") + F.col("y"))
    got = spatial.gwr_predict(data, data, ["v"], "t", bandwidth, target=50).toPandas().sort_values("id")
    assert np.allclose(got.gwr_pred, want, atol=1e-6)


def test_gwr_falls_back_to_the_mean(spark):
    train = spark.createDataFrame([(0.0, 0.0, 1.0, 2.0), (0.0, 0.0, 2.0, 4.0)], "x double, y double, f double, t double")
    far = spark.createDataFrame([(50.0, 50.0, 1.0)], "x double, y double, f double")
    assert spatial.gwr_predict(train, far, ["f"], "t", 1.0).first()["gwr_pred"] == pytest.approx(3.0)


def reference_dbscan(data, eps, least):
    s = (data - data.mean(0)) / data.std(0)
    near = np.sqrt(((s[:, None] - s) ** 2).sum(-1)) <= eps
    core, label, count = near.sum(1) >= least, np.full(len(s), -1), 0
    for i in range(len(s)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], count
            while stack:
                for q in np.flatnonzero(near[stack.pop()]):
                    if label[q] < 0:
                        label[q] = count
                        if core[q]:
                            stack.append(q)
            count += 1
    return np.where(label < 0, count, label)


def test_dbscan_equals_reference(points):
    df, pdf = points
    want = reference_dbscan(pdf[["x", "y"]].to_numpy(), 0.1, 5)
    got = spatial.dbscan(df, ["x", "y"], 0.1, 5, target=40).toPandas().sort_values("id")
    assert list(got.cluster) == list(want)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    other = spark.createDataFrame([(1001, 1000)], "a long, b long")
    labels = {r["node"]: r["label"] for r in spatial.connected_components(edges.union(other)).collect()}
    assert labels == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_nearest_cells_equal_brute_force(spark):
    r = np.random.default_rng(5)
    cells = pd.DataFrame({"cell_id": np.arange(400), "longitude": r.uniform(70, 80, 400), "latitude": r.uniform(20, 70, 400)})
    where = pd.DataFrame({"longitude": r.uniform(69, 81, 200), "latitude": r.uniform(18, 72, 200)})
    got = sampling.nearest_cells(spark.createDataFrame(where), spark.createDataFrame(cells), 50.0, target=30).toPandas()
    found = {(p.longitude, p.latitude): p.cell_id for p in got.itertuples()}
    for p in where.itertuples():
        i = int(np.argmin((cells.longitude - p.longitude) ** 2 + (cells.latitude - p.latitude) ** 2))
        lat1, lat2 = np.radians(p.latitude), np.radians(cells.latitude[i])
        h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(
            np.radians(cells.longitude[i] - p.longitude) / 2) ** 2
        inside = 2 * 6371 * np.arcsin(np.sqrt(h)) < 50
        assert found.get((p.longitude, p.latitude)) == (i if inside else None)


def test_cells_on_a_line_are_as_many_as_on_a_square(spark):
    r = np.random.default_rng(1)
    for xy in (np.c_[np.full(3000, 80.0), r.uniform(20, 50, 3000)], r.uniform(0, 1, (3000, 2))):
        data = spark.createDataFrame(pd.DataFrame(xy, columns=["x", "y"])).select(cells.vector("x", "y").alias("_w"))
        found = cells.fit_cells(data, 2, 30)
        assert len(found.counts) == 128 and found.counts.sum() == 3000 and found.counts.max() < 60 and found.counts.min() > 8
        coords = found.project(xy)
        at, leaf = found.visit(coords, np.full(3000, 0.5))
        own = found.locate(coords, np.array([t["t"] for t in data.select(F.xxhash64("_w").alias("t")).collect()]))
        inside = found.bound(coords, own + len(found.counts) - 1)
        assert (inside == 0).all() and set(zip(range(3000), own)) <= set(zip(at.tolist(), leaf.tolist()))


def test_equal_cuts_are_told_apart(spark):
    # every pivot distance is the same for many vectors: corners of a cube
    corners = np.array([[i >> b & 1 for b in range(10)] for i in range(1024)], float)
    data = spark.createDataFrame([(c.tolist(),) for c in corners], "_w array<double>")
    for pivots in (0, 4):
        assert cells.fit_cells(data, 10, 32, pivots).counts.max() <= 48


@pytest.mark.parametrize("p, target", [(2, 25), (8, 25), (8, 2000)])
def test_feature_neighbours_equal_brute_force(spark, p, target):
    r = np.random.default_rng(p)
    base = r.normal(size=(260, p)) @ r.normal(size=(p, p))
    base[100:140] = base[7]                        # many references at one place
    names = [f"f{i}" for i in range(p)]
    pdf = pd.DataFrame(base, columns=names)
    pdf["id"] = [f"r{i:03d}" for i in range(len(pdf))]
    df = spark.createDataFrame(pdf)
    odd = df.limit(3).withColumn("f0", F.when(F.col("id") == "r001", float("nan"))).withColumn("id", F.concat(F.lit("odd"), "id"))
    inverse = np.linalg.pinv(np.cov(base.T))
    diff = base[:, None] - base
    want = np.sqrt(np.maximum(np.einsum("ijk,kl,ijl->ij", diff, inverse, diff), 0))
    got = spatial.mahalanobis(df.unionByName(odd), df.unionByName(odd), names, 6, train=df, target=target).toPandas()
    assert len(got) == 6 * len(pdf)
    for i, part in got.groupby("id"):
        row = want[int(i[1:])]
        best = np.lexsort((np.arange(len(row)), np.round(row, 9)))[:6]
        found = sorted(zip(part.distance.round(9), part.ref))
        assert np.allclose([d for d, _ in found], np.sort(row)[:6], atol=1e-8)
        assert {x for d, x in found if d < row[best[-1]] - 1e-6} == {f"r{j:03d}" for j in best if row[j] < row[best[-1]] - 1e-6}


@pytest.mark.parametrize("columns", [("x", "y"), ("v",), ("x", "y", "v")])
def test_pair_statistics_of_the_whole_matrix(points, columns):
    df, pdf = points
    a = pdf[list(columns)].to_numpy()
    b = a[::3] + 0.25
    refs = df.where("id % 3 = 0").select(*[(F.col(c) + 0.25).alias(c) for c in columns])
    for one, two, d in ((df, df, np.sqrt(((a[:, None] - a) ** 2).sum(-1))), (df, refs, np.sqrt(((a[:, None] - b) ** 2).sum(-1)))):
        for target, tolerance in ((2000, 0.01), (12, 0.05), (12, 0.0)):
            row = spatial.pair_distance_stats(one, two, columns, tolerance=tolerance, target=target).first()
            assert row["pairs"] == d.size and row["min"] == pytest.approx(d.min(), abs=1e-12)
            assert row["max"] == pytest.approx(d.max()) and row["zero_share"] == pytest.approx((d < 1e-6).mean())
            assert abs(row["mean"] - d.mean()) <= row["mean_error"] + 1e-9 and row["mean_error"] <= tolerance * d.mean() * 1.5
            if row["mean_error"] == 0:
                assert row["std"] == pytest.approx(d.std())
    assert spatial.pair_distance_stats(df.limit(0), df, columns).first()["pairs"] == 0


def test_far_cells_are_not_compared(spark):
    r = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame(r.uniform(0, 1, (4000, 2)), columns=["x", "y"])).select(
        cells.vector("x", "y").alias("_w"), F.lit(1).alias("_n"))
    found = cells.fit_cells(df, 2, 40)
    own = cells.summary(df, found, np.zeros(2))
    plan = cells.plan_pairs(own, own, 0.05, 1e-6)
    assert len(plan.near) < 0.4 * len(found.counts) ** 2 and len(plan.looked) < 200 and plan.far_error > 0


def test_pair_distances(points):
    df, _ = points
    timed = df.withColumn("t", F.col("x") * 2)
    got = spatial.pair_distances(timed, timed, 3).collect()
    rows = [(r["id"], r["x"], r["y"]) for r in df.collect()]
    want = {}
    for i, x, y in rows:
        best = sorted((float(np.hypot(x - a, y - b)), j) for j, a, b in rows)[:3]
        want[i] = [round(d, 9) for d, _ in best]
    found = {}
    for r in got:
        found.setdefault(r["id"], []).append(round(r["space"], 9))
    assert {k: sorted(v) for k, v in found.items()} == want


def test_correlation_p_values():
    got = correlation_p(np.array([0.5, 0.1, -0.9, 0.0, 1.0]), np.array([20, 100, 5, 30, 10]))
    assert got == pytest.approx([0.0247696, 0.3222174, 0.0373861, 1.0, 0.0], abs=1e-6)


def test_density_clusters_of_text_ids(spark):
    df = spark.range(120).select(F.concat(F.lit("ST"), F.col("id").cast("string")).alias("station_id"), F.col("id").alias("num"),
                                 (F.col("id") % 3 * 50 + F.col("id") % 7 * 0.1).alias("a"), (F.col("id") % 5 * 0.1).alias("b"))
    def groups(key):
        found = {}
        for r in spatial.dbscan(df, ["a", "b"], 0.3, 3, key).join(df, key).collect():
            found.setdefault(r["cluster"], set()).add(r["num"])
        return sorted(map(sorted, found.values()))
    assert groups("station_id") == groups("num") and len(groups("num")) > 3


def test_distances_to_all_references(spark):
    r = np.random.default_rng(5)
    a, b = r.normal(size=(40, 2)) @ [[2, 1], [0, 1]], r.normal(size=(12, 2))
    points, refs = (spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(t)], "id long, x double, y double")
                    for t in (a, b))
    got = {(r["id"], r["ref"]): r["distance"] for r in spatial.mahalanobis(points, refs, ["x", "y"], None).collect()}
    inverse = np.linalg.inv(np.cov(a.T))
    want = {(i, j): np.sqrt((u - w) @ inverse @ (u - w)) for i, u in enumerate(a) for j, w in enumerate(b)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
