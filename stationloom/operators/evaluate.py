"""Metrics, comparisons and weight diagnostics. All are algebraic aggregates, merged from partial results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationloom.functions.scalar import known
from stationloom.operators.quality import tall
from stationloom.operators.ranking import exact_quantiles, null_safe, one_row, running_sums


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL for fewer than two pairs or a constant side."""
    x, y = known(x), known(y)
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    varied = (F.count(px) > 1) & (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    # corr() itself fails on a constant side in ANSI mode
    r = F.covar_pop(px, py) / F.nullif(F.stddev_pop(px) * F.stddev_pop(py), F.lit(0.0).cast("double"))
    return F.when(varied, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def metrics(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", group: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R, valid and total rows and their ratio."""
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    t, p = F.when(~F.isnan(t), t), F.when(~F.isnan(p), p)
    e = t - p
    return df.groupBy(*group).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), guarded_corr(t, p).alias("r"),
        F.count(e).alias("n"), F.count(F.lit(1)).alias("total"),
    ).withColumn("valid_ratio", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(F.lit(0.0)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return h


def correlation_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-value of a Pearson correlation: the regularised incomplete beta at 1 - r²."""
    from math import lgamma

    r, n = np.asarray(r, float), np.asarray(n, float)
    out = np.full(r.shape, np.nan)
    ok = np.isfinite(r) & (n > 2)
    out[np.isfinite(r) & (n == 2)] = 1.0
    x, a = np.clip(1 - r[ok] ** 2, 0, 1), (n[ok] - 2) / 2
    b = np.full_like(a, 0.5)
    log_front = np.array([lgamma(i + 0.5) - lgamma(i) - lgamma(0.5) for i in a])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_front + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        value = np.where(low, front * _beta_fraction(a, b, x) / a, 1 - front * _beta_fraction(b, a, 1 - x) / b)
    out[ok] = np.where(x == 0, 0.0, np.where(x == 1, 1.0, value))
    return out


@F.pandas_udf(T.DoubleType())
def _p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(correlation_p(r.to_numpy(float), n.to_numpy(float)))


def with_p_value(metric_rows: DataFrame) -> DataFrame:
    """p-value of ``r`` on already aggregated rows."""
    return metric_rows.withColumn("r_pvalue", F.when(F.col("r").isNotNull(), _p_value("r", "n")))


def fold_summary(folds: DataFrame, measures: Sequence[str] = ("mae", "rmse", "r")) -> DataFrame:
    """Mean, median and population deviation of fold metrics, unknown values skipped."""
    rows = tall(folds, measures, "metric", "value")
    stats = rows.groupBy("metric").agg(
        F.count("value").alias("folds"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return null_safe(stats, exact_quantiles(rows, "value", {"median": 0.5}, ["metric"]), ["metric"], "left")


def compare_schemes(overall: DataFrame, spread: DataFrame, first: str = "station", second: str = "yearly") -> DataFrame:
    """Which of two validation schemes wins. ``overall`` has scheme, mae, rmse, r; ``spread`` scheme, mae_std."""
    one = overall.join(spread, "scheme")

    def of(scheme: str, c: str) -> Column:
        return F.max(F.when(F.col("scheme") == scheme, F.col(c))).alias(f"{scheme}_{c}")

    row = one.agg(*[of(s, c) for s in (first, second) for c in ("mae", "rmse", "r", "mae_std")])
    a, b = F.col(f"{first}_r"), F.col(f"{second}_r")
    stable = F.col(f"{first}_mae_std") < F.col(f"{second}_mae_std")
    return row.select(
        (F.col(f"{first}_mae") < F.col(f"{second}_mae")).alias("first_better_mae"),
        (F.col(f"{first}_rmse") < F.col(f"{second}_rmse")).alias("first_better_rmse"),
        (a > b).alias("first_better_r"),
        F.when(stable, F.lit(first)).otherwise(F.lit(second)).alias("more_stable"),
        F.when(a > b, F.lit(first)).otherwise(F.lit(second)).alias("recommended"),
        F.when((a > b) & stable, F.lit(f"strong_{first}"))
        .when((b > a) & (F.col(f"{second}_mae_std") < F.col(f"{first}_mae_std")), F.lit(f"strong_{second}"))
        .otherwise(F.lit("mixed")).alias("advice"))


def compare_models(rows: DataFrame, base: str, candidate: str) -> DataFrame:
    """Improvement in percent of a candidate over a base model; ``rows`` has model, scheme, mae, r."""
    def of(model: str, c: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(c)))

    def gain(new: Column, old: Column) -> Column:
        return F.when(old != 0, (new - old) / F.abs(old) * 100)

    return rows.groupBy("scheme").agg(
        gain(of(candidate, "r"), of(base, "r")).alias("r_gain_pct"),
        gain(-of(candidate, "mae"), -of(base, "mae")).alias("mae_gain_pct"))


def compare_products(df: DataFrame, truth: str, products: Sequence[str], upper: Mapping[str, float] | None = None
                     ) -> DataFrame:
    """Metrics of each product against the observations; ``upper`` drops values above a product's limit."""
    limits = {"cswe": 200.0} if upper is None else upper
    masked = df.select(F.col(truth).cast("double").alias("_t"), *[
        (F.when(F.col(p) <= limits[p], F.col(p)) if p in limits else F.col(p)).cast("double").alias(p)
        for p in products])
    rows = masked.unpivot(["_t"], list(products), "product", "_p").where("_t is not null and _p is not null")
    return metrics(rows, "_t", "_p", ["product"]).select("product", "mae", "rmse", "r", "n")


def r_squared(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", group: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    t, p = known(t), known(p)
    both = t.isNotNull() & p.isNotNull()
    t, p = F.when(both, t), F.when(both, p)
    sse = F.sum((t - p) * (t - p))
    sst = F.var_pop(t) * F.count(t)
    return df.groupBy(*group).agg(
        F.when(sst > 0, 1 - sse / sst).alias("r2"), F.pow(guarded_corr(t, p), 2).alias("corr2"),
        F.avg(F.abs(t - p)).alias("mae"), F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"), F.count(t).alias("n"))


def regression_line(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", group: Sequence[str] = ()) -> DataFrame:
    """Line of prediction on observation: slope, intercept and standard error of the estimate, from one aggregate."""
    t, p = known(F.col(truth).cast("double")), known(F.col(pred).cast("double"))
    sums = df.groupBy(*group).agg(
        F.regr_count(p, t).alias("n"), F.regr_slope(p, t).alias("slope"), F.regr_intercept(p, t).alias("intercept"),
        F.regr_syy(p, t).alias("_syy"), F.regr_sxy(p, t).alias("_sxy"), F.regr_sxx(p, t).alias("_sxx"))
    left = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.nullif("_sxx", F.lit(0.0)), F.lit(0.0))
    return sums.select(*group, "n", "slope", "intercept", F.when(
        F.col("n") > 2, F.sqrt(left / (F.col("n") - 2))).alias("std_error"))


def run_summary(runs: DataFrame, measures: Sequence[str] = ("corr2", "mae", "rmse")) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("runs"), *[
        f(c).alias(f"{c}_{n}") for c in measures for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def cumulative_share(df: DataFrame, feature: str, importance: str) -> DataFrame:
    """Features by falling importance with rank and cumulative share of the total."""
    total = df.agg(F.sum(importance).alias("t")).scalar()
    ranked = running_sums(df.select(feature, importance), importance, [feature], {"_cum": importance},
                          descending=True)
    return ranked.select(feature, importance, F.col("_rank").alias("rank"),
                         (F.col("_cum") / total).alias("cumulative"))


def importance_stats(df: DataFrame, feature: str, importance: str, levels: Sequence[float] = (0.8, 0.9)) -> DataFrame:
    """Spread of the importances, shares of the top 5 and 10 and the ranks that reach each level."""
    ranked = cumulative_share(df, feature, importance)
    v, rank = F.col(importance), F.col("rank")
    return ranked.agg(
        F.count(F.lit(1)).alias("features"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"),
        F.stddev_samp(v).alias("std"), F.sum(F.when(rank <= 5, v)).alias("top5"),
        F.sum(F.when(rank <= 10, v)).alias("top10"), F.coalesce(F.sum(F.when(rank > 10, v)), F.lit(0.0)).alias("other"),
        F.min_by(feature, rank).alias("most_important"),
        *[F.coalesce(F.min(F.when(F.col("cumulative") >= lv, rank)), F.max(rank)).alias(f"rank_{round(lv * 100)}")
          for lv in levels])


def top_features(df: DataFrame, importance: str, feature: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.desc(importance), F.asc(feature)).limit(k)


def correlation_ranking(df: DataFrame, columns: Sequence[str], target: str, absolute: bool = False,
                        top: int | None = None) -> DataFrame:
    """Correlation of every column with the target from one aggregate."""
    t = F.col(target).cast("double")
    row = df.agg(*[guarded_corr(F.col(c).cast("double"), t).alias(c) for c in columns])
    ranked = row.unpivot([], list(columns), "feature", "correlation")
    if top is None:
        return ranked
    by = F.abs("correlation") if absolute else F.col("correlation")
    return ranked.orderBy(by.desc_nulls_last(), F.asc("feature")).limit(top)


def hash_sample(df: DataFrame, key: str, n: int = 5000) -> DataFrame:
    """Repeatable random sample: the n lowest hashes (a top-k, no full sort)."""
    h = F.md5(F.col(key).cast("string"))
    return df.orderBy(h, key).limit(n)


def histogram(df: DataFrame, value: str, bins: int = 50, log: bool = False) -> DataFrame:
    """Rows per equal-width bin of the value or of ``log1p`` of it; the last bin includes the maximum."""
    v = F.log1p(F.col(value)) if log else F.col(value).cast("double")
    base = df.select(known(v).alias("_v")).where("_v is not null")
    span = one_row(base.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    lo, hi = span.getField("lo"), span.getField("hi")
    at = F.when(hi > lo, F.least(F.floor((F.col("_v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).otherwise(0)
    return base.groupBy(at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("records"))


def weight_summary(df: DataFrame, weights: str = "weights") -> DataFrame:
    """Per weight column: mean, deviation, range and the shares near 0, near 1 and below 0."""
    rows = df.select(F.posexplode(weights).alias("pos", "w")).withColumn("w", known(F.col("w").cast("double")))
    w = F.col("w")

    def share(condition: Column) -> Column:
        return F.avg(F.when(condition, 1.0).otherwise(F.when(w.isNotNull(), 0.0)))

    return rows.groupBy("pos").agg(
        F.avg(w).alias("mean"), F.stddev_pop(w).alias("std"), F.min(w).alias("min"), F.max(w).alias("max"),
        (F.max(w) - F.min(w)).alias("range"), share(F.abs(w) < 0.01).alias("near_zero"),
        share(F.abs(F.abs(w) - 1) < 0.01).alias("near_one"), share(w < 0).alias("negative"),
        F.avg(F.abs(w - 1)).alias("distance_to_one"))


def weight_overall(df: DataFrame, weights: str = "weights") -> DataFrame:
    """One row over all weight columns: sizes, mean of means, mean of sample deviations and the range."""
    per = df.select(F.posexplode(weights).alias("pos", "w")).groupBy("pos").agg(
        F.count("w").alias("n"), F.avg("w").alias("m"), F.stddev_samp("w").alias("s"), F.min("w").alias("lo"),
        F.max("w").alias("hi"))
    return per.agg(F.max("n").alias("n_samples"), F.count(F.lit(1)).alias("n_weights"), F.avg("m").alias("mean"),
                   F.avg("s").alias("std"), F.min("lo").alias("min"), F.max("hi").alias("max"))


def with_weight_sum(df: DataFrame, weights: str = "weights", name: str = "weight_sum") -> DataFrame:
    return df.withColumn(name, F.aggregate(weights, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")))


def weight_sum_correlations(df: DataFrame, others: Sequence[str], weights: str = "weights") -> DataFrame:
    summed = with_weight_sum(df, weights)
    return summed.agg(*[guarded_corr(F.col("weight_sum"), F.col(c).cast("double")).alias(f"corr_{c}") for c in others])


def ks_distance(df: DataFrame, value: str, is_first: Column, is_second: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic. Equal values are counted first, so ties cost nothing."""
    counts = df.withColumn(value, known(F.col(value))).where((is_first | is_second) & F.col(value).isNotNull()).groupBy(value).agg(
        F.count_if(is_first).alias("_first"), F.count_if(is_second).alias("_second"))
    totals = one_row(counts.agg(F.sum("_first").alias("_first"), F.sum("_second").alias("_second")))
    running = running_sums(counts, value, [], {"_ca": "_first", "_cb": "_second"})
    gap = F.abs(F.col("_ca") / totals.getField("_first") - F.col("_cb") / totals.getField("_second"))
    return running.agg(F.max(gap).alias("d"), F.sum("_first").alias("n_first"), F.sum("_second").alias("n_second"))


def weight_stability(df: DataFrame, weights: str = "weights") -> DataFrame:
    """Coefficient of variation per weight column."""
    return weight_summary(df, weights).select(
        "pos", F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).alias("cv"))


def quartile_groups(df: DataFrame, by: str, value: str, include_lowest: bool = False) -> DataFrame:
    """Mean, deviation and count of ``value`` per quartile of ``by``.

    By default bins are closed on the left and the maximum is in none, with population deviation;
    ``include_lowest`` gives right-closed bins that hold every row, with sample deviation.
    """
    df = df.withColumns({c: known(F.col(c)) for c in dict.fromkeys([by, value])})
    edges = one_row(exact_quantiles(df, by, {f"q{i}": i / 4 for i in range(5)}))
    v, bin_ = F.col(by), F.lit(None).cast("int")
    for i in (3, 2, 1, 0):
        lo, hi = edges.getField(f"q{i}"), edges.getField(f"q{i + 1}")
        if include_lowest:
            inside = ((v > lo) | ((v == lo) & F.lit(i == 0))) & (v <= hi)
        else:
            inside = (v >= lo) & (v < hi)
        bin_ = F.when(inside, F.lit(i)).otherwise(bin_)
    spread = F.stddev_samp if include_lowest else F.stddev_pop
    return df.withColumn("bin", bin_).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), spread(value).alias("std"))


def feature_change(df: DataFrame, before: str, after: str) -> DataFrame:
    """Change statistics per feature position of two arrays."""
    rows = df.select(F.posexplode(F.arrays_zip(F.col(before).alias("x"), F.col(after).alias("z"))).alias("pos", "p"))
    x, z = F.col("p")["x"].cast("double"), F.col("p")["z"].cast("double")
    change = z - x
    return rows.groupBy("pos").agg(
        F.avg(change).alias("change_mean"), F.stddev_pop(change).alias("change_std"),
        F.avg(F.abs(change)).alias("abs_change_mean"),
        F.avg(F.abs(change) / (F.abs(x) + 1e-10)).alias("rel_change_mean"), F.max(F.abs(change)).alias("max_change"),
        F.avg(F.when(F.abs(change) > 0.001, 1.0).otherwise(0.0)).alias("significant_share"),
    ).withColumn("significant", F.col("abs_change_mean") > 0.001)


def coefficient_means(df: DataFrame, coefficients: Sequence[str], station: str = "station_id") -> DataFrame:
    """Station means of coefficients over rows that have all of them."""
    return df.dropna(subset=list(coefficients)).groupBy(station).agg(*[F.avg(c).alias(c) for c in coefficients])
