import contextlib
import io
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationloom.operators import ward


def plain_ward(w, k):
    """Greedy: the cheapest pair merges, by the Lance-Williams update of a matrix of costs."""
    n = {i: 1.0 for i in range(len(w))}
    cost = {(i, j): ((w[i] - w[j]) ** 2).sum() / 2 for i in range(len(w)) for j in range(i + 1, len(w))}
    groups = {i: [i] for i in range(len(w))}
    heights = []
    while len(groups) > 1:
        if len(groups) == k:
            parts = sorted(sorted(g) for g in groups.values())
        (i, j), c = min(cost.items(), key=lambda item: (item[1], item[0]))
        heights.append(c)
        for other in groups:
            if other not in (i, j):
                a, b = cost.pop((min(i, other), max(i, other))), cost.pop((min(j, other), max(j, other)))
                total = n[i] + n[j] + n[other]
                cost[(min(i, other), max(i, other))] = ((n[i] + n[other]) * a + (n[j] + n[other]) * b - n[other] * c) / total
        del cost[(i, j)]
        n[i] += n.pop(j)
        groups[i] += groups.pop(j)
    return parts, heights


@pytest.mark.parametrize("finish, target", [(45, 12), (2000, 2000)])
def test_same_partition_and_heights_as_greedy(spark, finish, target):
    r = np.random.default_rng(6)
    w = np.r_[r.normal(0, 1, (40, 3)), r.normal(4, 0.5, (25, 3)), r.normal([-5, 2, 0], 1.5, (15, 3))]
    pdf = pd.DataFrame(w, columns=["a", "b", "c"])
    pdf["id"] = [f"s{i:02d}" for i in range(len(w))]
    df = spark.createDataFrame(pdf)
    for k in (2, 5) if finish == 2000 else (5,):
        want, heights = plain_ward(w, k)
        got = ward.ward_clusters(df, ["a", "b", "c"], k, standardise=False, target=target, finish=finish).collect()
        found = {}
        for row in got:
            found.setdefault(row["cluster"], []).append(int(row["id"][1:]))
        assert sorted(map(sorted, found.values())) == want
        assert sorted(found) == list(range(k)) and [min(found[c]) for c in range(k)] == sorted(min(g) for g in want)
    places = df.select(F.col("id").alias("node"), F.array("a", "b", "c").alias("_w"), F.lit(1).alias("_n"))
    tree = ward.merges(places, 3, target, finish).toPandas()
    assert np.allclose(np.sort(tree.height), np.sort(heights)) and len(tree) == len(w) - 1


def test_copies_ties_and_few_rows(spark):
    rows = [(i, float(i % 3), 1.0) for i in range(30)] + [(99, None, 1.0), (98, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r["id"]: r["cluster"] for r in ward.ward_clusters(df, ["a", "b"], 3, finish=2).collect()}
    assert got == {i: i % 3 for i in range(30)}
    assert len(ward.ward_clusters(df, ["a", "b"], 8).select("cluster").distinct().collect()) == 3
    assert ward.ward_clusters(df.limit(0), ["a", "b"], 3).count() == 0
    # a ring of equal costs still ends
    ring = [(i, float(np.cos(i * np.pi / 3)), float(np.sin(i * np.pi / 3))) for i in range(6)]
    got = ward.ward_clusters(spark.createDataFrame(ring, "id long, a double, b double"), ["a", "b"], 3, standardise=False, finish=5)
    assert len({r["cluster"] for r in got.collect()}) == 3


def test_the_rest_needs_no_whole_matrix():
    r = np.random.default_rng(2)
    state = [{"node": i, "_w": [float(r.integers(0, 300)), float(r.integers(0, 300))], "_n": 1, "_h": 0.0} for i in range(ward.FINISH)]
    tracemalloc.start()
    merges = ward._merge_rest(state, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merges) == ward.FINISH - 1 and peak < 8 * ward.FINISH ** 2          # less than the matrix of costs


def test_estimated_sizes_do_not_multiply_from_turn_to_turn(spark, monkeypatch):
    """Their product's digits once grew several times a turn, and so did the driver's memory."""
    found, search = [], ward.nearest_clusters

    def seen(state, *args):
        with contextlib.redirect_stdout(io.StringIO()) as text:
            state.explain("cost")
        found.append(text.getvalue())
        return search(state, *args)

    monkeypatch.setattr(ward, "nearest_clusters", seen)
    r = np.random.default_rng(3)
    places = spark.createDataFrame([(i, [float(a), float(b)], 1) for i, (a, b) in enumerate(r.normal(size=(60, 2)))],
                                   "node long, _w array<double>, _n long")
    assert ward.merges(places, 2, finish=12).count() == 59 and len(found) > 2
    assert all(" KiB" in t or " B" in t for t in found) and not any(x in t for t in found for x in ("GiB", "TiB", "PiB", "EiB"))
