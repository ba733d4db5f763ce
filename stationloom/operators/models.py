"""Spark ML models, leave-one-group-out validation and model comparison."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationloom.functions.scalar import known
from stationloom.operators import boost
from stationloom.operators.evaluate import fold_summary, metrics
from stationloom.operators.features import fit_missing
from stationloom.operators.ranking import hash_order_rank, null_safe
from stationloom.operators.splits import group_folds, repeated_splits
from stationloom.session import ensure_checkpoint_dir

# Default settings of the boosted trees and of the forest benchmark.
BOOSTED = {"maxIter": 60, "stepSize": 0.17, "maxDepth": 5, "subsamplingRate": 0.8, "seed": 42}
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 2, "seed": 42}


def together(spark: SparkSession, tasks: Sequence[Callable], parallelism: int) -> list:
    """What the functions return; some run at a time, so that one's jobs use the cores while another plans."""
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(t) for t in tasks], chunksize=1)


def boosted_trees(label: str = "y", **settings) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=label, predictionCol="y_pred", **{**BOOSTED, **settings})


def least_squares(label: str = "y", **settings) -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol=label, predictionCol="y_pred", solver="normal", **settings)


def assemble(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector, label and kept columns of the labelled rows. Missing features must have been filled."""
    ready = df.select(*dict.fromkeys([*keep, label]), *[F.col(c).cast("double").alias(f"_x_{c}") for c in features])
    vector = VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="features", handleInvalid="error")
    return vector.transform(ready.where(F.col(label).isNotNull())).select(*dict.fromkeys([*keep, label]), "features")


def _labelled(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str]) -> DataFrame:
    """Labelled rows with numeric features; NaN is missing."""
    return df.where(known(F.col(label)).isNotNull()).select(
        *dict.fromkeys([*keep, label]), *[known(F.col(c).cast("double")).alias(f"_f_{c}") for c in features])


def _fit_and_predict(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, make: Callable,
                     keep: Sequence[str]) -> DataFrame:
    """Fill values come from the training rows alone, so nothing of the held-out rows enters the model."""
    columns = [f"_f_{c}" for c in features]
    plan = fit_missing(train, columns, strategy="mean")
    model = make(label).fit(assemble(plan.training(train), columns, label))
    return model.transform(assemble(plan.replay(test), columns, label, keep))


def _at_once(model) -> boost.Settings | None:
    """Settings under which ``boost`` grows the trees of such a boosting; None where it cannot.

    The first tree of a boosting enters whole, the others fit twice the residuals, as the gradient of squared error is.
    """
    if not isinstance(model, GBTRegressor):
        return None
    plain = {"lossType": "squared", "maxBins": boost.BINS, "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0,
             "featureSubsetStrategy": "all"}
    if any(model.getOrDefault(n) != v for n, v in plain.items()) or any(
            model.isDefined(n) for n in ("weightCol", "validationIndicatorCol")):
        return None
    return boost.Settings(model.getMaxIter(), 2 * model.getStepSize(), model.getMaxDepth(), model.getSubsamplingRate(),
                          model.getMinInstancesPerNode(), first=1.0, fill=True)


def _cross_validate(data: DataFrame, features: Sequence[str], label: str, make: Callable, keep: Sequence[str],
                    parallelism: int) -> DataFrame:
    """One model per value of ``fold``, NULL being a fold like others. The predictions are written with
    ``checkpoint``: every report would otherwise carry, and run, all the models again. Boosted trees of all folds grow
    together, other models are fitted one by one."""
    ensure_checkpoint_dir(data.sparkSession)
    if settings := _at_once(make(label)):
        model = boost.Boosting(data, [f"_f_{c}" for c in features], label, "fold", keep, settings, whole=False)
        if model.folds < 2:
            raise ValueError("cross-validation needs two folds with labelled rows")
        return model.grow().held_out().select(*dict.fromkeys([*keep, "fold"]), "y_true", "y_pred").checkpoint()
    data = data.persist()
    folds = sorted((r[0] for r in data.select("fold").distinct().collect()), key=lambda f: (f is None, f))

    @inheritable_thread_target(data.sparkSession)
    def run(fold) -> DataFrame:
        own = F.col("fold").eqNullSafe(F.lit(fold))
        return _fit_and_predict(data.where(~own), data.where(own), features, label, make, [*keep, "fold"])

    with ThreadPool(min(parallelism, max(1, len(folds)))) as pool:
        parts = pool.map(run, folds)
    out = reduce(DataFrame.unionByName, parts).select(
        *dict.fromkeys([*keep, "fold"]), F.col(label).cast("double").alias("y_true"), "y_pred").checkpoint()
    data.unpersist()
    return out


def leave_one_group_out(df: DataFrame, features: Sequence[str], label: str, group: str,
                        make: Callable = boosted_trees, keep: Sequence[str] = (), parallelism: int = 4) -> DataFrame:
    """Predictions of every labelled row by a model that never saw its group: ``fold, y_true, y_pred``.

    Every group is left out by itself, whatever their number: one fit per group. Rows without a group are one group.
    For least squares ``leave_one_group_out_ols`` needs no fits; ``group_k_fold`` bounds their number.
    """
    data = _labelled(df, features, label, [group, *keep]).withColumn("fold", F.col(group))
    return _cross_validate(data, features, label, make, [group, *keep], parallelism)


def group_k_fold(df: DataFrame, features: Sequence[str], label: str, group: str, folds: int,
                 make: Callable = boosted_trees, keep: Sequence[str] = (), parallelism: int = 4) -> DataFrame:
    """Like ``leave_one_group_out`` with whole groups dealt into ``folds`` folds; rows without a group are in the
    first."""
    data = _labelled(df, features, label, [group, *keep])
    dealt = group_folds(data.where(F.col(group).isNotNull()), group, folds)
    data = data.join(dealt, group, "left").withColumn("fold", F.coalesce("fold", F.lit(0)))
    return _cross_validate(data, features, label, make, [group, *keep], parallelism)


def leave_one_group_out_ols(df: DataFrame, features: Sequence[str], label: str, group: str,
                            keep: Sequence[str] = ()) -> DataFrame:
    """Exact leave-one-group-out predictions of least squares: ``fold, y_true, y_pred``, one fold per group.

    One aggregate gives the normal sums of every group; the model of a fold solves the total minus its own sums.
    Missing features are filled with the mean of the fold's training rows, which the sums allow for exactly: products
    with a missing factor are kept apart and multiplied by the fill value of each fold.
    """
    p = len(features)
    data = _labelled(df, features, label, [group, *keep])
    x, y = [F.col(f"_f_{c}") for c in features], F.col(label).cast("double")

    def total(value: Column, when: Column | None = None) -> Column:
        return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0.0))

    sums = [F.count(F.lit(1)).cast("double"), total(y)]
    sums += [s for a in x for s in (F.count(a).cast("double"), total(a), total(a * y), total(y, a.isNull()))]
    sums += [s for i in range(p) for j in range(p) for s in (
        total(x[i] * x[j]), total(x[j], x[i].isNull()), F.count_if(x[i].isNull() & x[j].isNull()).cast("double"))]
    per = data.groupBy(group).agg(F.array(*sums).alias("_own"))
    everything = per.agg(F.array(*[F.sum(F.get("_own", F.lit(i))) for i in range(len(sums))]).alias("_all")).scalar()

    @F.pandas_udf("array<double>")
    def solve(own: pd.Series, whole: pd.Series) -> pd.Series:
        left = np.vstack(whole.to_numpy()) - np.vstack(own.to_numpy())
        n, sy = left[:, 0], left[:, 1]
        single = left[:, 2:2 + 4 * p].reshape(-1, p, 4)
        known_n, sx, sxy, y_missing = (single[:, :, i] for i in range(4))
        fill = np.divide(sx, known_n, out=np.zeros_like(sx), where=known_n > 0)
        pair = left[:, 2 + 4 * p:].reshape(-1, p, p, 3)
        a = np.zeros((len(n), p + 1, p + 1))
        a[:, :p, :p] = (pair[..., 0] + fill[:, :, None] * pair[..., 1] + fill[:, None, :] * pair[..., 1].transpose(0, 2, 1)
                        + fill[:, :, None] * fill[:, None, :] * pair[..., 2])
        filled = sx + fill * (n[:, None] - known_n)
        a[:, :p, p] = a[:, p, :p] = filled
        a[:, p, p] = n
        b = np.concatenate([sxy + fill * y_missing, sy[:, None]], axis=1)
        scale = np.sqrt(np.maximum(np.einsum("gii->gi", a), 1e-300))       # even columns, then a safe inverse
        w = np.einsum("gij,gj->gi", np.linalg.pinv(a / scale[:, :, None] / scale[:, None, :], rcond=1e-12), b / scale) / scale
        w[n <= 0] = np.nan
        return pd.Series(list(np.concatenate([w, fill], axis=1)))

    models = per.select(group, solve("_own", everything).alias("_model"))
    rows = null_safe(data, models, [group])
    predicted = sum((F.get("_model", F.lit(i)) * F.coalesce(x[i], F.get("_model", F.lit(p + 1 + i))) for i in range(p)),
                    F.get("_model", F.lit(p)))
    return rows.select(*dict.fromkeys([group, *keep]), F.col(group).alias("fold"), y.alias("y_true"),
                       known(predicted).alias("y_pred"))


def cross_validation_report(predictions: DataFrame) -> dict[str, DataFrame]:
    """Overall, per-fold and summarised metrics of fold predictions."""
    folds = metrics(predictions, group=["fold"])
    return {"overall": metrics(predictions), "folds": folds, "summary": fold_summary(folds)}


def forest_per_cluster(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, cluster: str,
                       parallelism: int = 4, **settings) -> DataFrame:
    """Labelled test rows with the prediction of their own cluster's forest: ``cluster, y_true, y_pred``.

    Rows of a cluster without training rows, or of none, stay and have no prediction.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    # written once: every cluster would otherwise run the plan of the test rows, with its split, again
    data, held = (_labelled(df, features, label, [cluster]).checkpoint() for df in (train, test))
    names = sorted(r[0] for r in data.where(F.col(cluster).isNotNull()).select(cluster).distinct().collect())

    def forest(target: str) -> RandomForestRegressor:
        return RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol="y_pred",
                                     **{**FOREST, **settings})

    @inheritable_thread_target(spark)
    def run(name) -> DataFrame:
        own = F.col(cluster) == name
        return _fit_and_predict(data.where(own), held.where(own), features, label, forest, [cluster]).select(
            cluster, F.col(label).cast("double").alias("y_true"), "y_pred")

    with ThreadPool(min(parallelism, max(1, len(names)))) as pool:
        parts = pool.map(run, names)
    strange = held.where(F.col(cluster).isNull() | ~F.col(cluster).isin(names) if names else F.lit(True)).select(
        cluster, F.col(label).cast("double").alias("y_true"), F.lit(None).cast("double").alias("y_pred"))
    return reduce(DataFrame.unionByName, [*parts, strange]).checkpoint()


def ols(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()
        ) -> tuple[list[float], DataFrame]:
    """Least-squares coefficients (intercept last) and test predictions; missing features get the training means."""
    columns = [f"_f_{c}" for c in features]
    rows, asked = _labelled(train, features, label, []), _labelled(test, features, label, keep)
    plan = fit_missing(rows, columns, strategy="mean")
    model = least_squares(label).fit(assemble(plan.training(rows), columns, label))
    predicted = model.transform(assemble(plan.replay(asked), columns, label, keep))
    return [*map(float, model.coefficients), float(model.intercept)], predicted.select(
        *keep, F.col(label).cast("double").alias("y_true"), "y_pred")


def train_test(df: DataFrame, key: str, test: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Repeatable 80/20 split by hash rank."""
    ranked = hash_order_rank(df, key)
    held = F.col("rn") <= F.floor(F.col("n") * F.lit(float(test)).cast("double"))
    return ranked.where(~held).drop("rn", "n"), ranked.where(held).drop("rn", "n")


def standardized_model(df: DataFrame, features: Sequence[str], label: str, key: str, **settings) -> DataFrame:
    """Assembler, scaler and boosted trees fitted on 80 % of the labelled rows and applied to the rest.

    Missing features get the training means.
    """
    columns = [f"_f_{c}" for c in features]
    train, test = train_test(_labelled(df, features, label, [key]), key)
    fills = fit_missing(train, columns, strategy="mean")
    train, test = fills.training(train), fills.replay(test)
    plan = Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True), boosted_trees(label, **settings)])
    return plan.fit(train).transform(test).select(key, F.col(label).cast("double").alias("y_true"), "y_pred")


def importance_table(df: DataFrame, model, features: Sequence[str]) -> DataFrame:
    """``feature, importance`` of a fitted tree model; one row per feature."""
    values = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)],
                                           "feature string, importance double")


def fit_importance(df: DataFrame, features: Sequence[str], label: str, **settings) -> DataFrame:
    return importance_table(df, boosted_trees(label, **settings).fit(assemble(df, features, label)), features)


def grid_search(df: DataFrame, features: Sequence[str], label: str, group: str, grid: Mapping[str, Sequence],
                folds: int = 5, parallelism: int = 4, **settings) -> DataFrame:
    """Mean RMSE of every setting of a grid over folds of whole groups.

    Rows without a group are in the first fold; missing features get the means of the fold's training rows.
    """
    def run(values: tuple) -> tuple:
        own = {**settings, **dict(zip(grid, values))}
        found = group_k_fold(df, features, label, group, folds, lambda target: boosted_trees(target, **own), parallelism=parallelism)
        return *map(float, values), metrics(found, group=["fold"]).agg(F.avg("rmse")).first()[0]

    rows = together(df.sparkSession, [partial(run, values) for values in product(*grid.values())], parallelism)
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in [*grid, "rmse"]))


def _promising(space: Mapping[str, Sequence], seen: list[tuple[tuple, float]], rng: np.random.Generator,
               draws: int = 256) -> tuple | None:
    """The untried setting whose values stand most in the better quarter of the trials compared with the rest.

    A tree-structured Parzen estimate over listed values: every value of a parameter has a smoothed share among the good
    trials and one among the others. Small spaces are looked through whole, large ones by draws from the good shares.
    """
    values, tried = list(space.values()), {s for s, _ in seen}
    ranked = [s for s, _ in sorted(seen, key=lambda item: item[1])]
    cut = -(-len(ranked) // 4)

    def shares(part: list[tuple]) -> list[np.ndarray]:
        return [np.array([sum(s[i] == x for s in part) + 1.0 for x in v]) / (len(part) + len(v)) for i, v in enumerate(values)]

    good, rest = shares(ranked[:cut]), shares(ranked[cut:])
    size = int(np.prod([len(v) for v in values]))
    if size <= draws * 16:
        found = [s for s in product(*[range(len(v)) for v in values])]
    else:
        found = sorted({tuple(int(rng.choice(len(v), p=g)) for v, g in zip(values, good)) for _ in range(draws)})
    open_ = [s for s in found if tuple(v[i] for v, i in zip(values, s)) not in tried]
    if not open_:
        return None
    score = np.array([sum(np.log(g[i] / r[i]) for g, r, i in zip(good, rest, s)) for s in open_])
    best = np.flatnonzero(score >= score.max() - 1e-12)
    return tuple(v[i] for v, i in zip(values, open_[int(rng.choice(best))]))


def sequential_search(df: DataFrame, features: Sequence[str], label: str, group: str, space: Mapping[str, Sequence],
                      trials: int = 20, folds: int = 5, startup: int = 4, make: Callable = boosted_trees, seed: int = 42,
                      **settings) -> DataFrame:
    """``trial, <parameters>, folds, rmse, pruned``: settings tried one after another over folds of whole groups.

    The first ``startup`` settings are drawn at random, later ones where good trials lie. A trial whose mean error is
    above the median of the earlier trials after as many folds is given up. Rows without a group are in the first fold,
    missing features get the means of the fold's training rows. The same seed gives the same table.
    """
    data = _labelled(df, features, label, [group])
    dealt = group_folds(data.where(F.col(group).isNotNull()), group, folds)
    data = data.join(dealt, group, "left").withColumn("fold", F.coalesce("fold", F.lit(0))).persist()
    numbers = sorted(r[0] for r in data.select("fold").distinct().collect())
    rng, seen, rows, paths = np.random.default_rng(seed), [], [], []
    for trial in range(trials):
        if trial < startup:
            chosen = _promising(space, [(s, 0.0) for s, _ in seen], rng)        # no trial is better than another yet
        else:
            chosen = _promising(space, seen, rng)
        if chosen is None:
            break
        own, errors, pruned = {**settings, **dict(zip(space, chosen))}, [], False
        for k, fold in enumerate(numbers):
            mine = F.col("fold") == fold
            found = _fit_and_predict(data.where(~mine), data.where(mine), features, label,
                                     lambda target: make(target, **own), ["fold"])
            errors.append(found.agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col("y_pred"), 2)))).first()[0])
            mean = float(np.mean(errors))
            earlier = [p[k] for p in paths if len(p) > k]
            if trial >= startup and k + 1 < len(numbers) and earlier and mean > float(np.median(earlier)):
                pruned = True
                break
        paths.append([float(np.mean(errors[:k + 1])) for k in range(len(errors))])
        seen.append((chosen, paths[-1][-1]))
        rows.append((trial, *map(float, chosen), len(errors), paths[-1][-1], pruned))
    data.unpersist()
    kinds = ", ".join(f"`{n}` double" for n in space)
    return df.sparkSession.createDataFrame(rows, f"trial int, {kinds}, folds int, rmse double, pruned boolean")


def cross_validated(df: DataFrame, features: Sequence[str], label: str, group: str, make: Callable = boosted_trees,
                    folds: int | None = None) -> DataFrame:
    """Each group left out by itself, or whole groups in as many folds as the caller names."""
    if folds is None:
        return leave_one_group_out(df, features, label, group, make)
    return group_k_fold(df, features, label, group, folds, make)


def ablation(df: DataFrame, weighted: DataFrame, features: Sequence[str], label: str, group: str,
             make: Callable = boosted_trees, folds: int | None = None, parallelism: int = 2) -> DataFrame:
    """Overall metrics of the plain and of the weighted features under the same folds."""
    found = together(df.sparkSession, [partial(cross_validated, frame, features, label, group, make, folds) for frame in (df, weighted)],
                     parallelism)
    rows = [metrics(predictions).select(F.lit(name).alias("model"), F.lit(group).alias("scheme"), "mae", "rmse", "r", "n")
            for name, predictions in zip(("base", "weighted"), found)]
    return rows[0].unionByName(rows[1])


def repeated_runs(df: DataFrame, features: Sequence[str], label: str, stations: DataFrame, runs: int = 10,
                  make: Callable = boosted_trees, cluster: str = "cluster", station: str = "station_id") -> DataFrame:
    """Test predictions of independent cluster-stratified resamples: ``run, y_true, y_pred``.

    Only the station table is resampled; rows are picked by a semi-join per run. Summarise with
    ``r_squared(..., group=["run"])`` and ``run_summary``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    split = repeated_splits(stations, runs, cluster, station).select("run", station, "split").checkpoint()
    data = _labelled(df, features, label, [station]).persist()

    def rows(run: int, part: str) -> DataFrame:
        chosen = split.where((F.col("run") == run) & (F.col("split") == part)).select(station)
        return data.join(chosen, station, "left_semi")

    parts = [_fit_and_predict(rows(run, "train"), rows(run, "test"), features, label, make, [station]).select(
        F.lit(run).alias("run"), F.col(label).cast("double").alias("y_true"), "y_pred") for run in range(1, runs + 1)]
    out = reduce(DataFrame.unionByName, parts).checkpoint()
    data.unpersist()
    return out
