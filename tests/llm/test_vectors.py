import hashlib
import math

import numpy as np
import pytest

from stationloom.llm import centroids, whitening
from stationloom.llm.moments import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, _x string, n string, cluster string, _v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash", 1) for i, v in rows], SCHEMA).repartition(3)


def vectors(n, width=64, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, width)) * np.linspace(2, 0.3, width)
    return [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(base)]


def odd_vectors(width=64):
    """Good vectors with copies and repeated ids, and every kind of bad one."""
    rows = vectors(40, width)
    rows += [(100 + i, rows[7][1]) for i in range(15)] + [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1])]
    bad = [(200, None), (201, []), (202, [math.nan] + rows[0][1][1:]), (203, rows[0][1][:-1] + [math.inf]),
           (204, [None] + rows[0][1][1:]), (205, [-math.inf] * width)]
    return rows, bad


def whole(rows, scale):
    return [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows]


def plain_white(rows, weights="one", components=4):
    kept = whole(rows, 256)
    x = np.array(sorted(set(v for _, v in kept)), np.float64)
    w = np.array([sum(1 for _, v in kept if v == tuple(r)) if weights == "counts" else 1 for r in x.astype(int).tolist()], float)
    n, s = int(w.sum()), (w[:, None] * x).sum(axis=0)
    centred = x - s / n
    cov = (w[:, None] * centred).T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, v in kept:
        white = (np.array(v) - s / n) @ axes[:, :components] / np.sqrt(values[:components])
        far = sum((n * a - int(b)) ** 2 for a, b in zip(v, s))
        out.setdefault((i, v), []).append((n, far, np.abs(white), values[:components] / values.sum()))
    return kept, out


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening(spark, weights):
    rows, bad = odd_vectors()
    found = whitening.whiten(frame(spark, rows + bad), weights=weights).collect()
    kept, want = plain_white(rows, weights)
    assert len(found) == 4 * len(rows) and max(r.identity_error for r in found) < 1e-9
    by = {}
    for r in found:
        by.setdefault(r.vec_id, []).append(r)
    for i in {i for i, _ in kept}:
        options = [o for (k, _), os in want.items() if k == i for o in os]
        got = {}
        for r in by[i]:
            got.setdefault((r.n, r.deviation), {}).setdefault(r.component, []).append(r)
        for n, far, white, share in options:
            for c in range(4):
                assert any(abs(abs(r.whitened) - white[c]) < 1e-8 and abs(r.explained - share[c]) < 1e-9
                           for r in got[(n, far)][c + 1])


def test_whitening_has_one_sign(spark):
    rows = vectors(50, 6)
    found = whitening.whiten(frame(spark, rows)).collect()
    for c in range(1, 5):
        own = np.array([r.whitened for r in sorted(found, key=lambda r: r.vec_id) if r.component == c])
        assert abs(own.mean()) < 1e-9 and abs((own ** 2).mean() - 1) < 1e-9


def test_whitening_without_spread(spark):
    copies = [(i, [1.5, 2.5]) for i in range(5)]
    empty = whitening.whiten(frame(spark, copies))
    assert empty.count() == 0 and empty.columns[0] == "vec_id"
    assert whitening.whiten(frame(spark, []).limit(0)).count() == 0
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9
    mixed = whitening.whiten(frame(spark, vectors(20, 5) + [(100 + i, v) for i, v in vectors(20, 3)])).collect()
    assert len(mixed) == 20 * 4 + 20 * 3


def test_deviation_beyond_a_long():
    x = np.array([[1 << 40, 0], [0, 0]], np.int64)
    assert whitening._deviation(x, 2, [1 << 40, 0]) == [None, None]
    assert whitening._deviation(x[1:], 1, [0, 0]) == [0]


def plain_clusters(rows, rounds=3):
    kept = whole(rows, 64)
    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [list(v) for _, v in hashed[:16]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, own) if c == k]
            if mine:
                centres[k] = [sum(col) // len(mine) for col in zip(*mine)]
    best = [near(v) for _, v in kept]
    inertia = {k: sum(d for d, c in best if c == k) for k in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for (i, _), (d, k) in zip(kept, best)), key=repr)


def test_clusters(spark):
    rows, bad = odd_vectors()
    short = [(300, rows[0][1][:63]), (301, rows[0][1] + [1.0])]
    found = centroids.cluster(frame(spark, rows + bad + short)).collect()
    assert sorted(map(tuple, found), key=repr) == plain_clusters(rows)


def test_ties_take_the_smaller_number(spark):
    # small integers: many equal distances
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(0, 2, 64) / 64]) for i in range(120)]
    found = centroids.cluster(frame(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == plain_clusters(rows)


def test_few_rows_and_none(spark):
    rows = vectors(3)
    assert sorted(map(tuple, centroids.cluster(frame(spark, rows)).collect()), key=repr) == plain_clusters(rows)
    assert centroids.cluster(frame(spark, [(None, rows[0][1])])).count() == 0
    assert centroids.cluster(frame(spark, []).limit(0)).count() == 0


def test_large_entries_stay_exact(spark):
    rows = vectors(30)
    rows[3] = (3, [3e9] + rows[3][1][1:])
    rows[8] = (8, [-7e8] * 64)
    want = [tuple(None if isinstance(v, int) and v >= 1 << 63 else v for v in r) for r in plain_clusters(rows)]
    assert sorted(map(tuple, centroids.cluster(frame(spark, rows)).collect()), key=repr) == sorted(want, key=repr)


def test_filter_leaves_out_most_pairs():
    rng = np.random.default_rng(2)
    centre = rng.integers(-400, 400, (16, 64))
    points = (centre[rng.integers(0, 16, 2000)] + rng.integers(-40, 40, (2000, 64))).astype(np.int64)
    values, axes = np.linalg.eigh(np.cov(points.T, bias=True))
    rotation = centroids.Rotation(points.mean(axis=0), axes[:, ::-1][:, :12])
    best, least, compared = centroids.nearest(points, *rotation(points), centre, rotation)
    exact = ((points[:, None] - centre) ** 2).sum(axis=2)
    assert (least == exact.min(axis=1)).all() and (best == exact.argmin(axis=1)).all()
    assert compared.mean() < 1.5 and SMALL > 400
