"""Metrics, comparisons and weight diagnostics."""

from pyspark.sql import functions as F

from checks.base import Views, case, rounded
from stationloom.operators import evaluate, features, quality

METRICS = """round(avg(abs(y_true - y_pred)), 4) as mae, round(sqrt(avg((y_true - y_pred)*(y_true - y_pred))), 4) as rmse,
    round(corr(y_true, y_pred), 8) as r, count(y_true - y_pred) as n, count(*) as total,
    round(count(y_true - y_pred)/cast(count(*) as double), 8) as valid_ratio"""


def _round(df):
    return rounded(rounded(df, 4, "mae", "rmse"), 8, *[c for c in ("r", "valid_ratio") if c in df.columns])


@case("metrics_overall", f"select {METRICS} from (select case when l_tax = 0.08 then null else y_true end y_true, y_pred from pred)")
def _(v: Views):
    df = v.pred.withColumn("y_true", F.when(F.col("l_tax") != 0.08, F.col("y_true")))
    return _round(evaluate.metrics(df))


@case("metrics_by_fold", f"select fold, {METRICS} from pred group by 1")
def _(v: Views):
    return _round(evaluate.metrics(v.pred, group=["fold"]))


@case("metrics_by_year", f"select yr, {METRICS} from pred group by 1")
def _(v: Views):
    return _round(evaluate.metrics(v.pred, group=["yr"]))


#: Student's distribution has a finite series for whole degrees of freedom; sin = |r|, cos = sqrt(1 - r*r).
@case("metric_p_values", """with f as (select fold, avg(abs(l_discount - l_tax)) as mae, sqrt(avg((l_discount - l_tax)*(l_discount - l_tax))) as rmse,
    corr(l_discount, l_tax) as r, count(*) as n from pred group by 1),
    k as (select fold, n - 2 as v, r, unnest(range(0, greatest(cast(floor((n - 2)/2.0) as bigint), 1))) as k from f where n > 2 and r is not null),
    e as (select *, case when k = 0 then 1.0 when v % 2 = 0 then (2*k - 1)/(2.0*k)*(1 - r*r) else 2*k/(2.0*k + 1)*(1 - r*r) end as factor from k),
    c as (select fold, v, r, exp(sum(ln(factor)) over (partition by fold order by k)) as term from e),
    s as (select fold, any_value(v) as v, any_value(r) as r, sum(term) as series from c group by 1),
    p as (select fold, 1 - case when v % 2 = 0 then abs(r)*series when v = 1 then 2/pi()*asin(abs(r))
        else 2/pi()*(asin(abs(r)) + abs(r)*sqrt(1 - r*r)*series) end as p from s)
    select f.fold, round(mae, 6) as mae, round(rmse, 6) as rmse, round(r, 6) as r, n, n as total, 1.0::double as valid_ratio,
    case when r is null then null when n = 2 then 1.0 else round(p, 6) end as r_pvalue from f left join p using (fold)""")
def _(v: Views):
    table = evaluate.with_p_value(evaluate.metrics(v.pred, "l_discount", "l_tax", ["fold"]))
    return rounded(table, 6, "mae", "rmse", "r", "r_pvalue")


FOLDS = """with f as (select fold, avg(abs(y_true - y_pred)) as mae, sqrt(avg((y_true - y_pred)*(y_true - y_pred))) as rmse, corr(y_true, y_pred) as r from pred group by 1)"""


@case("fold_summary", FOLDS + " " + " union all ".join(
    f"select '{m}' as metric, count({m}) as folds, round(avg({m}), 6) as mean, round(stddev_pop({m}), 6) as std, round(median({m}), 6) as median from f"
    for m in ("mae", "rmse", "r")))
def _(v: Views):
    return rounded(evaluate.fold_summary(evaluate.metrics(v.pred, group=["fold"])), 6, "mean", "std", "median")


def _scheme(name: str, group: str, factor: int) -> str:
    return f"""select '{name}' scheme, avg(abs(y_true - p)) mae, sqrt(avg((y_true - p)*(y_true - p))) rmse, corr(y_true, p) r,
        (select stddev_pop(m) from (select avg(abs(y_true - l_quantity*{factor})) m from pred group by {group})) mae_std
        from (select y_true, l_quantity*{factor} p from pred)"""


@case("scheme_compare", f"""with a as ({_scheme('station', 'fold', 1500)}), b as ({_scheme('yearly', 'yr', 1900)})
    select a.mae < b.mae as first_better_mae, a.rmse < b.rmse as first_better_rmse, round(a.r, 9) > round(b.r, 9) as first_better_r,
    case when a.mae_std < b.mae_std then 'station' else 'yearly' end as more_stable,
    case when round(a.r, 9) > round(b.r, 9) then 'station' else 'yearly' end as recommended,
    case when round(a.r, 9) > round(b.r, 9) and a.mae_std < b.mae_std then 'strong_station'
    when round(b.r, 9) > round(a.r, 9) and b.mae_std < a.mae_std then 'strong_yearly' else 'mixed' end as advice from a, b""")
def _(v: Views):
    overall, spread = [], []
    for scheme, group, factor in (("station", "fold", 1500), ("yearly", "yr", 1900)):
        df = v.pred.withColumn("y_pred", F.col("l_quantity") * factor)
        overall.append(evaluate.metrics(df).select(F.lit(scheme).alias("scheme"), "mae", "rmse", F.round("r", 9).alias("r")))
        spread.append(evaluate.metrics(df, group=[group]).agg(F.stddev_pop("mae").alias("mae_std")).select(
            F.lit(scheme).alias("scheme"), "mae_std"))
    return evaluate.compare_schemes(overall[0].unionByName(overall[1]), spread[0].unionByName(spread[1]))


@case("model_compare", """with m as (select l_returnflag as scheme, avg(abs(l_extendedprice - l_quantity*1500)) ma, corr(l_extendedprice, l_quantity) ra,
    avg(abs(l_extendedprice - l_quantity*1500*(1 - l_discount))) mb, corr(l_extendedprice, l_quantity*(1 - l_discount)) rb from lineitem group by 1)
    select scheme, round((rb - ra)/abs(ra)*100, 6) as r_gain_pct, round((ma - mb)/abs(ma)*100, 6) as mae_gain_pct from m""")
def _(v: Views):
    df = v.table("lineitem").withColumn("scheme", F.col("l_returnflag"))
    rows = [evaluate.metrics(df.withColumn("p", p), "l_extendedprice", "p", ["scheme"]).withColumn("model", F.lit(n))
            for n, p in (("base", F.col("l_quantity") * 1500),
                         ("weighted", F.col("l_quantity") * 1500 * (1 - F.col("l_discount"))))]
    return rounded(evaluate.compare_models(rows[0].unionByName(rows[1]), "base", "weighted"), 6, "r_gain_pct", "mae_gain_pct")


def _product(name: str, expr: str, condition: str = "true") -> str:
    return f"""select '{name}' as product, round(avg(abs(y_true - p)), 4) as mae, round(sqrt(avg((y_true - p)*(y_true - p))), 4) as rmse,
        round(corr(y_true, p), 8) as r, count(*) as n from (select y_true, {expr} p from pred) where {condition}"""


@case("product_compare", " union all ".join([
    _product("cswe", "l_quantity*5", "p <= 200"), _product("era5_swe", "y_true*(1 - l_discount)"),
    _product("glsnow", "y_true*(1 + l_tax)"), _product("gldas", "l_quantity*2000")]))
def _(v: Views):
    df = v.pred.select("y_true", (F.col("l_quantity") * 5).alias("cswe"), (F.col("y_true") * (1 - F.col("l_discount"))).alias("era5_swe"),
                       (F.col("y_true") * (1 + F.col("l_tax"))).alias("glsnow"), (F.col("l_quantity") * 2000).alias("gldas"))
    return _round(evaluate.compare_products(df, "y_true", ["cswe", "era5_swe", "glsnow", "gldas"]))


R2 = """round(1 - sum((y_true - y_pred)*(y_true - y_pred))/(var_pop(y_true)*count(y_true)), 8) as r2, round(power(corr(y_true, y_pred), 2), 8) as corr2,
    round(avg(abs(y_true - y_pred)), 4) as mae, round(sqrt(avg((y_true - y_pred)*(y_true - y_pred))), 4) as rmse, count(*) as n"""


@case("r2", f"select yr, {R2} from pred group by 1")
def _(v: Views):
    return rounded(rounded(evaluate.r_squared(v.pred, group=["yr"]), 8, "r2", "corr2"), 4, "mae", "rmse")


@case("run_summary", """with f as (select yr, power(corr(y_true, y_pred), 2) as corr2, avg(abs(y_true - y_pred)) as mae, sqrt(avg((y_true - y_pred)*(y_true - y_pred))) as rmse from pred group by 1)
    select count(*) as runs, round(avg(corr2), 8) as corr2_mean, round(stddev_pop(corr2), 8) as corr2_std, round(avg(mae), 4) as mae_mean,
    round(stddev_pop(mae), 4) as mae_std, round(avg(rmse), 4) as rmse_mean, round(stddev_pop(rmse), 4) as rmse_std from f""")
def _(v: Views):
    out = evaluate.run_summary(evaluate.r_squared(v.pred, group=["yr"]))
    return rounded(rounded(out, 8, "corr2_mean", "corr2_std"), 4, "mae_mean", "mae_std", "rmse_mean", "rmse_std")


IMPORTANCE = "with i as (select l_partkey as feature, cast(sum(l_quantity) as double) as importance from lineitem group by 1)"


def _importance(v: Views):
    return v.table("lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("importance"))


@case("cumulative_share", f"""{IMPORTANCE} select feature, importance, row_number() over w as rank,
    round(sum(importance) over (w rows unbounded preceding)/(select sum(importance) from i), 9) as cumulative from i window w as (order by importance desc, feature)""")
def _(v: Views):
    return rounded(evaluate.cumulative_share(_importance(v), "feature", "importance"), 9, "cumulative")


@case("importance_stats", f"""{IMPORTANCE}, r as (select *, row_number() over w as rank, sum(importance) over (w rows unbounded preceding)/(select sum(importance) from i) c from i window w as (order by importance desc, feature))
    select count(*) as features, round(avg(importance), 6) as mean, max(importance) as max, min(importance) as min, round(stddev_samp(importance), 6) as std,
    sum(importance) filter (rank <= 5) as top5, sum(importance) filter (rank <= 10) as top10, sum(importance) filter (rank > 10) as other,
    (select feature from r where rank = 1) as most_important, min(rank) filter (c >= 0.8) as rank_80, min(rank) filter (c >= 0.9) as rank_90 from r""")
def _(v: Views):
    return rounded(evaluate.importance_stats(_importance(v), "feature", "importance"), 6, "mean", "std")


@case("top_features", f"{IMPORTANCE} select feature, importance from i order by importance desc, feature limit 15")
def _(v: Views):
    return evaluate.top_features(_importance(v), "importance", "feature", 15)


@case("corr_ranking", """select 'l_quantity' as feature, round(corr(l_quantity, l_extendedprice), 8) as correlation from lineitem
    union all select 'l_tax', round(corr(l_tax, l_extendedprice), 8) from lineitem union all select 'l_discount', round(corr(l_discount, l_extendedprice), 8) from lineitem
    union all select 'one', null""")
def _(v: Views):
    df = v.table("lineitem").withColumn("one", F.lit(1.0))
    return rounded(evaluate.correlation_ranking(df, ["l_quantity", "l_tax", "l_discount", "one"], "l_extendedprice"), 8, "correlation")


#: A tenth of the values is NaN, which counts as missing.
NAN_SQL = """(select ord, station_id, case when ord % 10 = 3 then null else swe end as swe, case when ord % 10 = 7 then null
    else cast(ord % 1000 as double) end as x from obs)"""


def _with_nan(v: Views):
    k, nan = F.col("ord") % 10, F.lit(float("nan"))
    return v.obs.select("ord", "station_id", F.when(k == 3, nan).otherwise(F.col("swe")).alias("swe"),
                        F.when(k == 7, nan).otherwise((F.col("ord") % 1000).cast("double")).alias("x"))


@case("nan_correlation", f"""select 'x' as feature, round(corr(x, swe), 8) as correlation from {NAN_SQL}""")
def _(v: Views):
    return rounded(evaluate.correlation_ranking(_with_nan(v), ["x"], "swe"), 8, "correlation")


@case("nan_r2", f"""with p as (select swe as t, x*0.3 as p from {NAN_SQL} where swe is not null and x is not null)
    select round(1 - sum((t - p)*(t - p))/(var_pop(t)*count(*)), 8) as r2, round(power(corr(t, p), 2), 8) as corr2,
    round(avg(abs(t - p)), 6) as mae, round(sqrt(avg((t - p)*(t - p))), 6) as rmse, count(*) as n from p""")
def _(v: Views):
    df = _with_nan(v).select(F.col("swe").alias("y_true"), (F.col("x") * 0.3).alias("y_pred"))
    return rounded(rounded(evaluate.r_squared(df), 8, "r2", "corr2"), 6, "mae", "rmse")


@case("nan_histogram", f"""with b as (select swe as v from {NAN_SQL} where swe is not null), s as (select min(v) lo, max(v) hi from b)
    select cast(least(floor((v - lo)/((hi - lo)/50)), 49) as bigint) as bin, count(*) as records from b, s group by 1""")
def _(v: Views):
    return evaluate.histogram(_with_nan(v), "swe")


@case("nan_fill_rates", f"""select 'swe' as "column", count(swe) as filled, count(*) as records, round(100.0*count(swe)/count(*), 6) as fill_pct from {NAN_SQL}
    union all select 'x', count(x), count(*), round(100.0*count(x)/count(*), 6) from {NAN_SQL}""")
def _(v: Views):
    return rounded(quality.fill_rates(_with_nan(v), ["swe", "x"]), 6, "fill_pct")


@case("nan_value_summary", f"""select count(swe) as n, min(swe) as min, max(swe) as max, round(avg(swe), 6) as mean,
    round(median(swe), 6) as median, round(stddev_samp(swe), 6) as std from {NAN_SQL}""")
def _(v: Views):
    return rounded(quality.value_summary(_with_nan(v), "swe"), 6, "mean", "median", "std")


@case("nan_impute", f"""select ord, round(coalesce(swe, (select avg(swe) from {NAN_SQL})), 6) as swe,
    round(coalesce(x, (select avg(x) from {NAN_SQL})), 6) as x from {NAN_SQL}""")
def _(v: Views):
    filled = features.impute(_with_nan(v).drop("station_id"), ["swe", "x"], strategy="mean")
    return rounded(filled, 6, "swe", "x")


@case("regression_line", """select l_suppkey as fold, count(*) as n, round(regr_slope(y_pred, y_true), 9) as slope,
    round(regr_intercept(y_pred, y_true), 5) as intercept,
    round(sqrt(greatest(regr_syy(y_pred, y_true) - power(regr_sxy(y_pred, y_true), 2)/regr_sxx(y_pred, y_true), 0)/(count(*) - 2)), 4) as std_error
    from (select l_suppkey, l_extendedprice as y_true, l_quantity*1500 as y_pred from lineitem) group by 1 having count(*) > 2""")
def _(v: Views):
    out = evaluate.regression_line(v.pred, group=["fold"]).where("n > 2")
    return rounded(rounded(rounded(out, 9, "slope"), 5, "intercept"), 4, "std_error")


@case("random_sample", "select num, altitude from station order by md5(cast(num as varchar)), num limit 100")
def _(v: Views):
    return evaluate.hash_sample(v.station.select("num", "altitude"), "num", 100)


def _bins(expr: str) -> str:
    return f"""with x as (select {expr} v from obs where swe is not null), b as (select min(v) lo, max(v) hi from x)
    select cast(least(floor((v - lo)/((hi - lo)/50)), 49) as bigint) as bin, count(*) as records from x, b group by 1"""


@case("histogram", _bins("swe"))
def _(v: Views):
    return evaluate.histogram(v.obs, "swe")


@case("histogram_log", _bins("ln(1 + swe)"))
def _(v: Views):
    return evaluate.histogram(v.obs, "swe", log=True)


TALL = "(select id, label, cast(i - 1 as bigint) as pos, weights[i] as w from (select *, unnest(range(1, 65)) i from weights))"
SUMS = "(select id, label, sum(w) as weight_sum from " + TALL + " group by 1, 2)"


@case("weight_summary", f"""select pos, round(avg(w), 9) as mean, round(stddev_pop(w), 9) as std, round(min(w), 9) as min, round(max(w), 9) as max, round(max(w) - min(w), 9) as "range",
    round(avg(case when abs(w) < 0.01 then 1.0::double else 0 end), 9) as near_zero, round(avg(case when abs(abs(w) - 1) < 0.01 then 1.0::double else 0 end), 9) as near_one,
    round(avg(case when w < 0 then 1.0::double else 0 end), 9) as negative, round(avg(abs(w - 1)), 9) as distance_to_one from {TALL} group by 1""")
def _(v: Views):
    out = evaluate.weight_summary(v.weights)
    return rounded(out, 9, *[c for c in out.columns if c != "pos"])


@case("weight_overall", f"""with c as (select pos, count(*) n, avg(w) m, stddev_samp(w) s, min(w) lo, max(w) hi from {TALL} group by 1)
    select max(n) as n_samples, count(*) as n_weights, round(avg(m), 9) as mean, round(avg(s), 9) as std, round(min(lo), 9) as min, round(max(hi), 9) as max from c""")
def _(v: Views):
    return rounded(evaluate.weight_overall(v.weights), 9, "mean", "std", "min", "max")


@case("weight_sums", f"select id, round(weight_sum, 9) as weight_sum from {SUMS}")
def _(v: Views):
    return rounded(evaluate.with_weight_sum(v.weights).select("id", "weight_sum"), 9, "weight_sum")


@case("weight_sum_corr", f"select round(corr(weight_sum, s.lon), 8) as corr_lon, round(corr(weight_sum, s.lat), 8) as corr_lat, round(corr(weight_sum, s.altitude), 8) as corr_altitude from {SUMS} x join station s on s.num = x.id")
def _(v: Views):
    df = v.weights.join(v.station.select(F.col("num").alias("id"), "lon", "lat", "altitude"), "id")
    out = evaluate.weight_sum_correlations(df, ["lon", "lat", "altitude"])
    return rounded(out, 8, *out.columns)


@case("ks_distance", f"""with s as (select weight_sum as v, label from {SUMS}), n as (select count(*) filter (label = 0) a, count(*) filter (label = 1) b from s),
    c as (select v, sum(count(*) filter (label = 0)) over (order by v) ca, sum(count(*) filter (label = 1)) over (order by v) cb from s group by v)
    select round(max(abs(ca/cast(a as double) - cb/cast(b as double))), 9) as d, max(a) as n_first, max(b) as n_second from c, n""")
def _(v: Views):
    df = evaluate.with_weight_sum(v.weights)
    return rounded(evaluate.ks_distance(df, "weight_sum", F.col("label") == 0, F.col("label") == 1), 9, "d")


@case("ks_distance_large", """with s as (select l_extendedprice as v, l_returnflag f from lineitem), n as (select count(*) filter (f = 'A') a, count(*) filter (f = 'R') b from s),
    c as (select v, sum(count(*) filter (f = 'A')) over (order by v) ca, sum(count(*) filter (f = 'R')) over (order by v) cb from s group by v)
    select round(max(abs(ca/cast(a as double) - cb/cast(b as double))), 9) as d, max(a) as n_first, max(b) as n_second from c, n""")
def _(v: Views):
    return rounded(evaluate.ks_distance(v.table("lineitem"), "l_extendedprice", F.col("l_returnflag") == "A",
                                        F.col("l_returnflag") == "R"), 9, "d")


@case("weight_stability", f"select pos, round(stddev_pop(w)/abs(avg(w)), 6) as cv from {TALL} where label in (0, 1) group by 1")
def _(v: Views):
    return rounded(evaluate.weight_stability(v.weights.where("label in (0, 1)")), 6, "cv")


@case("quartile_groups", f"""with s as (select weight_sum v, label from {SUMS}), q as (select quantile_cont(v, 0) q0, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.5) q2, quantile_cont(v, 0.75) q3, quantile_cont(v, 1) q4 from s),
    b as (select label, case when v >= q0 and v < q1 then 0 when v >= q1 and v < q2 then 1 when v >= q2 and v < q3 then 2 when v >= q3 and v < q4 then 3 end bin from s, q)
    select cast(bin as bigint) as bin, count(*) as n, round(avg(label), 9) as mean, round(stddev_pop(label), 9) as std from b where bin is not null group by 1""")
def _(v: Views):
    return rounded(evaluate.quartile_groups(evaluate.with_weight_sum(v.weights), "weight_sum", "label"), 9, "mean", "std")


@case("quartile_groups_longitude", """with q as (select quantile_cont(lon, 0) q0, quantile_cont(lon, 0.25) q1, quantile_cont(lon, 0.5) q2, quantile_cont(lon, 0.75) q3, quantile_cont(lon, 1) q4 from station),
    b as (select altitude, case when lon >= q0 and lon <= q1 then 0 when lon > q1 and lon <= q2 then 1 when lon > q2 and lon <= q3 then 2 when lon > q3 and lon <= q4 then 3 end bin from station, q)
    select cast(bin as bigint) as bin, count(*) as n, round(avg(altitude), 6) as mean, round(stddev_samp(altitude), 6) as std from b group by 1""")
def _(v: Views):
    return rounded(evaluate.quartile_groups(v.station, "lon", "altitude", include_lowest=True), 6, "mean", "std")


@case("feature_change", """with t as (select cast(i - 1 as bigint) as pos, weights[i] as x, weights[i]*weights[65 - i] as z from (select *, unnest(range(1, 65)) i from weights))
    select pos, round(avg(z - x), 9) as change_mean, round(stddev_pop(z - x), 9) as change_std, round(avg(abs(z - x)), 9) as abs_change_mean,
    round(avg(abs(z - x)/(abs(x) + 1e-10)), 6) as rel_change_mean, round(max(abs(z - x)), 9) as max_change,
    round(avg(case when abs(z - x) > 0.001 then 1.0::double else 0 end), 9) as significant_share, avg(abs(z - x)) > 0.001 as significant from t group by 1""")
def _(v: Views):
    df = v.weights.withColumn("after", F.zip_with("weights", F.reverse("weights"), lambda x, w: x * w))
    out = evaluate.feature_change(df, "weights", "after")
    return rounded(rounded(out, 9, "change_mean", "change_std", "abs_change_mean", "max_change", "significant_share"), 6, "rel_change_mean")


@case("coef_by_station", """select station_id, round(avg(swe), 9) as coef_swe, round(avg(ord), 9) as coef_ord from obs where swe is not null group by 1""")
def _(v: Views):
    df = v.obs.select("station_id", F.col("swe").alias("coef_swe"), F.col("ord").alias("coef_ord"))
    return rounded(evaluate.coefficient_means(df, ["coef_swe", "coef_ord"]), 9, "coef_swe", "coef_ord")
