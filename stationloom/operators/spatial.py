"""Neighbours, spatial autocorrelation, weighted regression and clustering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import erfc, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from stationloom.functions.scalar import known
from stationloom.operators import cells as cellular
from stationloom.operators.cells import TARGET, rows_of, vector
from stationloom.operators.features import scale_like
from stationloom.operators.integrate import attach_cluster
from stationloom.operators.normalize import row_ids
from stationloom.operators.ranking import one_row
from stationloom.session import ensure_checkpoint_dir


def _placed(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose coordinates are all known, with them as ``_w``; -0.0 and 0.0 are one place."""
    return df.dropna(subset=list(columns)).withColumn("_w", F.transform(vector(*columns), lambda v: v + F.lit(0.0)))


def _offered(df: DataFrame, key: str, most: int) -> DataFrame:
    """``did, _w``: the smallest keys of every place; no neighbour list can ever take more of them."""
    at_place = Window.partitionBy("_w").orderBy("did")
    # row_number under a limit is cut down before the shuffle (window group limit)
    return df.select(F.col(key).alias("did"), "_w").withColumn(
        "_n", F.row_number().over(at_place)).where(F.col("_n") <= most).select("did", "_w")


def knn(points: DataFrame, k: int = 8, key: str = "id", x: str = "x", y: str = "y",
        target: int = TARGET) -> DataFrame:
    """``points`` rows with ``neighbor, distance, rank``: the k nearest other points by distance, then id.

    Positions are searched once however many points share them, and a position offers its k+1 smallest
    ids, which is all a neighbour list ordered by (distance, id) can ever take from it.
    """
    ensure_checkpoint_dir(points.sparkSession)
    base = _placed(points, x, y)
    offered = _offered(base, key, k + 1).checkpoint()
    places = offered.select("_w").distinct()
    near = cellular.nearest(places.withColumn("qid", F.col("_w")), offered, k + 1, cellular.fit_cells(places, 2, target))
    joined = base.join(near.withColumnRenamed("qid", "_w"), "_w")
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col(key)), 1, k)
    listed = joined.select(*points.columns, F.posexplode(others).alias("_at", "_hit"))
    return listed.select(*points.columns, F.col("_hit")["id"].alias("neighbor"),
                         F.col("_hit")["dist"].alias("distance"), (F.col("_at") + 1).alias("rank"))


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: erfc(abs(v) / sqrt(2)))


def with_normal_p(df: DataFrame, z: str = "z") -> DataFrame:
    """Two-sided normal p-value of one-row statistics."""
    return df.withColumn("p_norm", _normal_p(z))


def morans_i(points: DataFrame, value: str, k: int = 8, key: str = "id", x: str = "x", y: str = "y",
             target: int = TARGET) -> DataFrame:
    """Moran's I over row-standardised kNN weights with its expectation, normal variance and z.

    The neighbour table is built once. Each edge then counts for its pair (value product, mutual links)
    and for its neighbour's in-degree in a single aggregate.
    """
    rows = points.where(known(F.col(value)).isNotNull())
    mean = rows.agg(F.avg(value)).scalar()
    z = rows.select(key, x, y, (F.col(value) - mean).alias("_z"))
    edges = knn(z, k, key, x, y, target).select(F.col(key).alias("_i"), "neighbor", "_z")
    both = edges.join(z.select(F.col(key).alias("neighbor"), F.col("_z").alias("_zj")), "neighbor")
    # mutual links: a pair seen from both ends; in-degree: edges by neighbour
    split = both.select(F.explode(F.array(
        F.struct(F.lit("pair").alias("kind"), F.least("_i", "neighbor").alias("a"),
                 F.greatest("_i", "neighbor").alias("b"), (F.col("_z") * F.col("_zj")).alias("zz")),
        F.struct(F.lit("node").alias("kind"), F.col("neighbor").alias("a"), F.col("neighbor").alias("b"),
                 F.lit(0.0).cast("double").alias("zz")))).alias("e"))
    grouped = split.select("e.*").groupBy("kind", "a", "b").agg(
        F.count(F.lit(1)).alias("c"), F.sum("zz").alias("zz"))
    sums = grouped.agg(
        F.sum("zz").alias("cross"), F.sum(F.when((F.col("kind") == "pair") & (F.col("c") == 2), 2)
                                          .otherwise(0)).alias("mutual"),
        F.sum(F.when(F.col("kind") == "node", F.col("c") * F.col("c"))).alias("deg2"))
    totals = one_row(z.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("zz")))
    n = F.col("n")
    s1, s2 = n / k + F.col("mutual") / (k * k), 3 * n + F.col("deg2") / (k * k)
    return sums.withColumns({"n": totals.getField("n"), "_zz": totals.getField("zz")}).withColumns({
        "i": F.col("cross") / k / F.col("_zz"), "ei": -1 / (n - 1),
        "vi": (n * n * s1 - n * s2 + 3 * n * n) / ((n * n - 1) * n * n) - F.pow(1 / (n - 1), 2),
    }).select("n", "i", "ei", "vi", ((F.col("i") - F.col("ei")) / F.sqrt("vi")).alias("z"))


def local_r2(df: DataFrame, truth: str, local_prediction: Column) -> DataFrame:
    """Per-row ``local_r2``: 1 - squared error over the total sum of squares (0 when there is none)."""
    sst = df.agg((F.var_pop(truth) * F.count(truth)).alias("s")).scalar()
    return df.withColumn("local_r2", F.when(sst > 0, 1 - F.pow(F.col(truth) - local_prediction, 2) / sst)
                         .otherwise(F.lit(0.0)))


def local_r2_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("local_r2").alias("mean"), F.stddev_pop("local_r2").alias("std"),
                  F.min("local_r2").alias("min"), F.max("local_r2").alias("max")
                  ).withColumn("cv", F.col("std") / F.col("mean"))


def linearity_verdict(moran_p: Column, cv: Column, forest_r2: Column, r2: Column) -> Column:
    return F.when((moran_p < 0.05) | (cv > 0.3) | (forest_r2 > r2 + 0.05), F.lit("nonlinear")).otherwise(
        F.lit("linear"))


def _moment_names(p: int) -> list[str]:
    return [f"s_{i}_{j}" for i in range(p) for j in range(i, p)] + [f"s_{i}_y" for i in range(p)]


def gwr_sums(train: DataFrame, targets: DataFrame, features: Sequence[str], label: str, bandwidth: float,
             x: str = "x", y: str = "y", support: float = 10.0, target: int = TARGET) -> DataFrame:
    """Weighted normal sums at every distinct target position: ``x, y, w_max, s_i_j, s_i_y`` (0 is the intercept).

    The weight depends on the position alone, so training rows are reduced to moments per position first. Targets
    without a training row within ``support`` bandwidths have no row here. Beyond ``support`` bandwidths a Gaussian weight is under 2e-22 and cannot matter.
    """
    ensure_checkpoint_dir(train.sparkSession)
    p = len(features) + 1
    names = _moment_names(p)
    terms = [F.lit(1.0).cast("double"), *[F.col(f).cast("double") for f in features]]
    products = [terms[i] * terms[j] for i in range(p) for j in range(i, p)] + [t * F.col(label) for t in terms]
    rows = train.dropna(subset=[x, y, label, *features])
    moments = rows.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(
        *[F.sum(e).alias(n) for e, n in zip(products, names)])
    moments = moments.withColumn("_w", vector("x", "y")).drop("x", "y").checkpoint()
    queries = _placed(targets, x, y).select("_w").distinct().withColumn("_r", F.lit(float(support * bandwidth)))
    schema = "_w array<double>, w_max double, " + ", ".join(f"{n} double" for n in names)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        m = np.stack([right[n].to_numpy() for n in names], axis=1)
        asked, held = rows_of(left["_w"], 2), rows_of(right["_w"], 2)
        out = np.zeros((len(asked), len(names) + 1))
        step = max(1, cellular.BLOCK // max(len(held), 1))
        for start in range(0, len(asked), step):
            d = cellular.distances(asked[start:start + step], held)
            w = np.where(d <= support * bandwidth, np.exp(-0.5 * (d / bandwidth) ** 2), 0.0)
            out[start:start + step, 0], out[start:start + step, 1:] = w.max(axis=1), w @ m
        return pa.table([left["_w"], *(pa.array(c) for c in out.T)], ["_w", "w_max", *names])

    found = cellular.fit_cells(moments, 2, target)
    parts = cellular.on_cells(cellular.with_visited(queries, found), cellular.with_cell(moments, found), add_up, schema,
                              "_w", "_w")
    summed = parts.groupBy("_w").agg(F.max("w_max").alias("w_max"), *[F.sum(n).alias(n) for n in names])
    return summed.select(F.col("_w")[0].alias(x), F.col("_w")[1].alias(y), "w_max", *names)


def gwr_predict(train: DataFrame, targets: DataFrame, features: Sequence[str], label: str, bandwidth: float,
                x: str = "x", y: str = "y", support: float = 10.0, target: int = TARGET, out: str = "gwr_pred") -> DataFrame:
    """Target rows with a locally weighted prediction; the training mean where no fit exists."""
    p = len(features) + 1
    names = _moment_names(p)
    sums = gwr_sums(train, targets, features, label, bandwidth, x, y, support, target)
    upper = [(i, j) for i in range(p) for j in range(i, p)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch[n].to_numpy() for n in names], axis=1)
            a = np.zeros((len(values), p, p))
            for at, (i, j) in enumerate(upper):
                a[:, i, j] = a[:, j, i] = values[:, at]
            # a matrix that has no inverse is left out of the stack: one solve for all others
            sound = (batch["w_max"].to_numpy() >= 1e-10) & (np.linalg.matrix_rank(a) == p)
            beta = np.zeros((len(a), p))
            beta[sound] = np.linalg.solve(a[sound], values[sound, len(upper):, None])[:, :, 0]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(beta.reshape(-1)), p).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch[x], batch[y], pc.if_else(pa.array(sound), lists, pa.scalar(None, lists.type))], [x, y, "_beta"])

    betas = sums.mapInArrow(solve, T.StructType([
        sums.schema[x], sums.schema[y], T.StructField("_beta", T.ArrayType(T.DoubleType()))]))
    mean = train.agg(F.avg(label)).scalar()
    joined = targets.join(betas, [x, y], "left")
    fitted = F.col("_beta")[0]
    for i, f in enumerate(features):
        fitted = fitted + F.col("_beta")[i + 1] * F.col(f)
    return joined.withColumn(out, F.coalesce(F.when(F.col("_beta").isNotNull(), fitted), mean)).drop("_beta")


def _nearest_references(base: DataFrame, refs: DataFrame, width: int, k: int, key: str, target: int,
                        pivots: int = 0) -> DataFrame:
    """``base`` rows (with ``_w``) and ``near``, their k nearest references by distance and then id."""
    ensure_checkpoint_dir(base.sparkSession)
    offered = _offered(refs, key, k).checkpoint()
    index = cellular.fit_cells(offered.select("_w").distinct(), width, target, pivots)
    near = cellular.nearest(base.select("_w").distinct().withColumn("qid", F.col("_w")), offered, k, index)
    return base.join(near.withColumnRenamed("qid", "_w"), "_w")


def pair_distances(points: DataFrame, references: DataFrame, k: int = 8, key: str = "id", x: str = "x", y: str = "y",
                   t: str = "t", target: int = TARGET) -> DataFrame:
    """Spatial and temporal distance of each point to its ``k`` nearest references, by distance and then id.

    Both sides are cut into cells, so neither has to be small, and the output grows with the points alone.
    """
    refs = _placed(references, x, y)
    listed = _nearest_references(_placed(points, x, y), refs, 2, k, key, target).select(
        key, F.col(t).alias("_t"), F.explode("near").alias("_hit")).select(
        key, "_t", F.col("_hit")["id"].alias("ref"), F.col("_hit")["dist"].alias("space"))
    times = refs.select(F.col(key).alias("ref"), F.col(t).alias("_rt"))
    return listed.join(times, "ref").select(key, "ref", "space", F.abs(F.col("_t") - F.col("_rt")).alias("time"))


def pair_distance_stats(points: DataFrame, references: DataFrame, columns: Sequence[str] = ("x", "y"), zero: float = 1e-6,
                        tolerance: float = 0.01, target: int = TARGET) -> DataFrame:
    """Statistics of the whole distance matrix: ``pairs, min, max, mean, std, zero_share, mean_error``, one row.

    No pair is listed. Equal places are one weighted place. Cells of both sides that are far apart enter the mean with
    their centres and spreads, within ``tolerance`` of their distance; all other cells are compared in blocks. The
    largest and least distance come from the cells whose boxes may hold them, the deviation from moments and the mean.
    ``min``, ``max`` and ``zero_share`` are exact, ``mean`` within ``mean_error``, which is zero where every pair of
    cells was compared, as it is with ``tolerance=0``: work that grows with the square of the number of places.
    """
    spark, width = points.sparkSession, len(columns)
    ensure_checkpoint_dir(spark)

    def side(df: DataFrame) -> DataFrame:
        return _placed(df, *columns).groupBy("_w").agg(F.count(F.lit(1)).alias("_n")).checkpoint()

    left = side(points)
    right = left if references is points else side(references)
    middle = right.agg(*[F.coalesce(F.avg(F.col("_w")[j]), F.lit(0.0)) for j in range(width)]).first()
    sums = []
    for places in (left, right):
        sums.append(cellular.summary(places, cellular.fit_cells(places, width, target), np.array(middle)))
    a, b = sums
    pairs = int(a.weight[0]) * int(b.weight[0])
    out = "pairs long, min double, max double, mean double, std double, zero_share double, mean_error double"
    if not pairs:
        return spark.createDataFrame([(0, None, None, None, None, None, None)], out)
    plan = cellular.plan_pairs(a, b, tolerance, zero)
    listed = [(n, i, j) for n, (i, j) in enumerate(np.concatenate([plan.near, plan.looked]).tolist())]
    chosen = spark.createDataFrame(pd.DataFrame(listed, columns=["_pair", "_i", "_j"]))

    def of(places: DataFrame, found: cellular.Cells, name: str) -> DataFrame:
        return cellular.with_cell(places, found).join(chosen.select("_pair", F.col(name).alias("_cell")), "_cell").select(
            "_w", "_n", F.col("_pair").alias("_cell"))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        own, other = rows_of(x["_w"], width), rows_of(y["_w"], width)
        n, m = (t["_n"].to_numpy().astype(float) for t in (x, y))
        total, close, least, largest = 0.0, 0.0, np.inf, -np.inf
        step = max(1, cellular.BLOCK // len(other))
        for start in range(0, len(own), step):
            d = cellular.distances(own[start:start + step], other)
            total += float(n[start:start + step] @ (d @ m))
            close += float(n[start:start + step] @ ((d < zero) @ m))
            least, largest = min(least, d.min()), max(largest, d.max())
        return pa.table({"pair": x["_cell"][:1], "total": [total], "close": [close], "least": [least], "largest": [largest]})

    compared = cellular.on_cells(of(left, a.cells, "_i"), of(right, b.cells, "_j"), compare,
                                 "pair long, total double, close double, least double, largest double", "_w", "_w")
    # the second moment about a common middle needs no pair at all
    centre = [s.sums[0] / s.weight[0] for s in sums]
    square = sum(float(np.trace(s.squares[0])) / s.weight[0] for s in sums) - 2 * float(centre[0] @ centre[1])
    added = F.col("pair") < len(plan.near)
    mean = (F.coalesce(F.sum(F.when(added, F.col("total"))), F.lit(0.0)) + F.lit(plan.far_sum)) / F.lit(float(pairs))
    found = compared.agg(F.min("least").alias("min"), F.max("largest").alias("max"), mean.alias("mean"), (
        F.coalesce(F.sum(F.when(added, F.col("close"))), F.lit(0.0)) / F.lit(float(pairs))).alias("zero_share"))
    return found.select(F.lit(pairs).cast("long").alias("pairs"), "min", "max", "mean", F.sqrt(F.greatest(
        F.lit(square) - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"), "zero_share",
        F.lit(plan.far_error / pairs).alias("mean_error"))


def mahalanobis(points: DataFrame, references: DataFrame, features: Sequence[str], k: int | None = 8, key: str = "id",
                train: DataFrame | None = None, target: int = TARGET) -> DataFrame:
    """``key, ref, distance``: the k nearest references in feature space, whitened by the covariance of the training rows;
    with ``k=None`` every reference, one row per pair.

    Points and references are whitened once. The references are a metric index: cells cut by their distances to pivots,
    pruned by the triangle inequality; a point searches its own cell and then those its k-th distance reaches. Rows
    with a missing feature have no distance. Only the covariance reaches the driver.
    """
    source = (points if train is None else train).dropna(subset=list(features))
    p = len(features)
    row = source.agg(*[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features)
                       for j, b in enumerate(features) if j >= i], *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)], float)
    values, axes = np.linalg.eigh(np.linalg.pinv(cov, hermitian=True))
    turn = axes * np.sqrt(np.maximum(values, 0))

    def white(df: DataFrame) -> DataFrame:
        centred = [F.col(f).cast("double") - F.lit(float(row[f"m{i}"] or 0.0)) for i, f in enumerate(features)]
        parts = [sum((c * F.lit(float(turn[i, j])) for i, c in enumerate(centred)), F.lit(0.0)) for j in range(p)]
        return df.dropna(subset=list(features)).withColumn("_w", F.array(*parts))

    if k is None:
        refs = white(references).select(F.col(key).alias("ref"), F.col("_w").alias("_v"))
        apart = F.sqrt(sum((F.pow(F.col("_w")[j] - F.col("_v")[j], 2) for j in range(p)), F.lit(0.0)))
        return white(points).select(key, "_w").crossJoin(refs).select(key, "ref", apart.alias("distance"))
    near = _nearest_references(white(points).select(key, "_w"), white(references), p, k, key, target, min(2 * p, 16))
    return near.select(key, F.explode("near").alias("_hit")).select(
        key, F.col("_hit")["id"].alias("ref"), F.col("_hit")["dist"].alias("distance"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` (smallest id reached) from edges ``a, b`` by alternating large and small stars.

    Each round is written with ``checkpoint`` to the shared folder, so a lost executor costs one round. The rounds
    go on until no edge changes.
    """
    ensure_checkpoint_dir(edges.sparkSession)

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both if large else both.where("b < a")
        lowest = around.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        joined = around.join(lowest, "a")
        linked = joined.where("b > a") if large else joined
        out = linked.select(F.col("b").alias("a"), F.col("_m").alias("b"))
        if not large:
            out = out.unionByName(lowest.select("a", F.col("_m").alias("b")))
        return out.where("a <> b").distinct()

    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = None
    while True:
        current = star(star(current, True), False).checkpoint()
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    labels = current.groupBy("a").agg(F.min("b").alias("label"))
    return nodes.join(labels, nodes["node"] == labels["a"], "left").select(
        "node", F.coalesce("label", "node").alias("label"))


def dbscan(df: DataFrame, features: Sequence[str], eps: float = 0.5, min_points: int = 5, key: str = "id",
           target: int = TARGET) -> DataFrame:
    """Density clusters of standardised rows: ``key, cluster``, noise in one extra cluster.

    Equal rows are one weighted point, named by its smallest key. A grid of side ``eps / sqrt(p)`` over all features
    comes first: the points of a box are all within ``eps``, so a box that weighs ``min_points`` is all core, and the
    core points of a box are one node. Only points of lighter boxes count their neighbours, and links join boxes. The
    neighbours of a point are found on cells over all features. A border point joins its cluster with the smallest key.
    """
    ensure_checkpoint_dir(df.sparkSession)
    p = len(features)
    kept, scaled = [f"_v{i}" for i in range(p)], [f"_f{i}" for i in range(p)]      # a feature may be called like a column here
    raw = df.dropna(subset=[key, *features]).select(key, *[(F.col(f).cast("double") + F.lit(0.0)).alias(v)
                                                           for f, v in zip(features, kept)])
    unique = raw.groupBy(*kept).agg(F.min(key).alias("qid"), F.count(F.lit(1)).alias("_n"))
    both = {s: F.col(v) for s, v in zip(scaled, kept)}
    points = scale_like(raw.withColumns(both), unique.withColumns(both), scaled, "standard", epsilon=0.0)
    # a constant feature has no spread and no say
    points = points.select("qid", "_n", *kept, F.array(*[
        F.coalesce(F.when(~F.isnan(s), F.col(s)), F.lit(0.0)) for s in scaled]).alias("_w")).checkpoint()
    side = F.lit(float(eps) / sqrt(p))
    boxes = points.withColumn("_box", F.transform("_w", lambda v: F.floor(v / side)))
    weight = boxes.groupBy("_box").agg(F.sum("_n").alias("_weight"))
    boxes = boxes.join(weight, "_box").checkpoint()
    index = cellular.fit_cells(points, p, target)
    kind = dict(points.dtypes)["qid"]

    def close(left: pa.Table, right: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
        asked, held = rows_of(left["_w"], p), rows_of(right["_w"], p)
        step = max(1, cellular.BLOCK // max(len(held), 1))
        for start in range(0, len(asked), step):
            yield slice(start, start + step), cellular.distances(asked[start:start + step], held) <= eps

    def reaching(rows: DataFrame) -> DataFrame:
        return cellular.with_visited(rows.withColumn("_r", F.lit(float(eps))), index).drop("_r")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        n, w = np.zeros(left.num_rows, np.int64), right["_n"].to_numpy()
        for part, near in close(left, right):
            n[part] = near @ w
        return pa.table([left["qid"], pa.array(n)], ["qid", "n"])

    light = boxes.where(F.col("_weight") < min_points).select("qid", "_w")
    counted = cellular.on_cells(reaching(light), cellular.with_cell(points.select("qid", "_w", "_n"), index), count,
                                f"qid {kind}, n long", "qid", "qid").groupBy("qid").agg(F.sum("n").alias("n"))
    core = boxes.where(F.col("_weight") >= min_points).unionByName(boxes.join(
        counted.where(F.col("n") >= min_points).select("qid"), "qid", "left_semi")).select("qid", "_w", "_box")
    core = core.join(core.groupBy("_box").agg(F.min("qid").alias("node")), "_box").drop("_box").checkpoint()

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pairs of boxes that have core points within reach of each other, each once."""
        names, number = np.unique(np.concatenate([t["node"].to_numpy(zero_copy_only=False) for t in (left, right)]),
                                  return_inverse=True)
        a, b, found = number[:left.num_rows], number[left.num_rows:], [np.zeros(0, np.int64)]
        for part, near in close(left, right):
            row, col = np.nonzero(near & (a[part, None] < b))
            found.append(np.unique(a[part][row].astype(np.int64) * len(names) + b[col]))
        pairs = np.unique(np.concatenate(found))
        return pa.table([pa.array(names[pairs // len(names)], left["node"].type),
                         pa.array(names[pairs % len(names)], left["node"].type)], ["a", "b"])

    held = cellular.with_cell(core, index)
    edges = cellular.on_cells(reaching(core), held, link, f"a {kind}, b {kind}", "qid", "qid").distinct().checkpoint()
    labels = connected_components(edges)
    labelled = core.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).drop("node").checkpoint()

    def border(left: pa.Table, right: pa.Table) -> pa.Table:
        names, number = np.unique(right["label"].to_numpy(zero_copy_only=False), return_inverse=True)
        found = np.full(left.num_rows, len(names))
        for part, near in close(left, right):
            found[part] = np.where(near, number, len(names)).min(axis=1)
        hit = np.flatnonzero(found < len(names))
        return pa.table([left["qid"].take(pa.array(hit)), pa.array(names[found[hit]], right["label"].type)], ["qid", "label"])

    rest = light.join(core.select("qid"), "qid", "left_anti")
    edge_points = cellular.on_cells(reaching(rest), cellular.with_cell(labelled, index), border, f"qid {kind}, label {kind}",
                                    "qid", "qid").groupBy("qid").agg(F.min("label").alias("label"))
    assigned = labelled.select("qid", "label").unionByName(edge_points)
    numbers = row_ids(labelled.select("label").distinct(), "label", "cluster")
    clustered = points.select("qid", *kept).join(assigned.join(numbers, "label"), "qid").select(
        *kept, F.col("cluster").cast("bigint").alias("cluster")).checkpoint()
    return attach_noise(raw.join(clustered, kept, "left").select(key, "cluster"), clustered)


def attach_noise(rows: DataFrame, clustered: DataFrame) -> DataFrame:
    """Unassigned rows share the number after the largest cluster."""
    top = clustered.agg(F.coalesce(F.max("cluster"), F.lit(-1)).alias("t")).scalar()
    return rows.withColumn("cluster", F.coalesce("cluster", top + 1))


__all__ = ["knn", "morans_i", "gwr_sums", "gwr_predict", "pair_distances", "pair_distance_stats", "mahalanobis",
           "dbscan", "connected_components", "local_r2", "local_r2_summary",
           "linearity_verdict", "with_normal_p", "attach_cluster"]
