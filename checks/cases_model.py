"""Models and validation. Fits are Spark ML with the default settings of the library."""

from pyspark.sql import functions as F

from checks.base import Views, case, rounded
from stationloom.operators import boost, evaluate, features, models
from stationloom.plans import evaluation


def _frame(v: Views):
    df = v.obs.where("swe is not null").join(v.station.select("station_id", "lon", "lat", "altitude", "landuse_code"), "station_id")
    return df.withColumns({"year": F.year("date"), "doy": F.dayofyear("date")})


FEATURES = ["lon", "lat", "altitude", "doy"]


def _beats_constant(table, error: str = "rmse"):
    """What SQL can know of a tree model: the rows and truth of a fold, and that its error is below the spread."""
    return table.select("fold", "n", F.round("truth", 3).alias("truth"), (F.col(error) < F.col("spread")).alias("better"))


def _by_fold(predictions):
    e = F.col("y_true") - F.col("y_pred")
    return predictions.groupBy("fold").agg(
        F.count(e).alias("n"), F.sum("y_true").alias("truth"), F.sqrt(F.avg(e * e)).alias("rmse"),
        # the swe of the tables does not depend on the features: a fit may only not be much worse than the mean
        (1.25 * F.stddev_pop("y_true")).alias("spread"))


@case("logo_cv_gbt", """select year(o.date) as fold, count(*) as n, round(sum(o.swe), 3) as truth, true as better
    from obs o join station s using (station_id) where o.swe is not null group by 1""")
def _(v: Views):
    return _beats_constant(_by_fold(models.leave_one_group_out(_frame(v), FEATURES, "swe", "year")))


@case("station_cv_gbt", """with k as (select station_id, (row_number() over (order by md5(station_id), station_id) - 1) % 5 as fold
    from (select distinct station_id from obs where swe is not null))
    select k.fold, count(*) as n, round(sum(o.swe), 3) as truth, true as better from obs o join station s using (station_id)
    join k using (station_id) where o.swe is not null group by 1""")
def _(v: Views):
    return _beats_constant(_by_fold(models.group_k_fold(_frame(v), FEATURES, "swe", "station_id", 5)))


# The next two return what the trees say. SQL cannot grow them: tests/test_boost.py compares with refits, one per group.
@case("boosted_cv_metrics")
def _(v: Views):
    found, _ = boost.boosted_cross_validation(_frame(v), FEATURES, "swe", "year", trees=4, depth=3)
    return rounded(models.cross_validation_report(found)["folds"].select("fold", "n", "mae", "rmse", "r"), 6, "mae", "rmse", "r")


@case("boosted_importance")
def _(v: Views):
    _, importance = boost.boosted_cross_validation(_frame(v), FEATURES, "swe", "landuse_code", trees=4, depth=3)
    return rounded(importance, 6, "importance")


HASH_TEST = """(select *, row_number() over (order by md5(cast(ord as varchar)), ord) <= floor(count(*) over () * 0.2::double) as held
    from (select o.ord, o.swe, s.zone from obs o join station s using (station_id) where o.swe is not null))"""


@case("cluster_rf", f"""select zone as fold, count(*) as n, round(sum(swe), 3) as truth, true as better from {HASH_TEST}
    where held group by 1""")
def _(v: Views):
    train, test = models.train_test(_frame(v).join(v.station.select("station_id", "zone"), "station_id"), "ord")
    out = models.forest_per_cluster(train, test, FEATURES, "swe", "zone")
    return _beats_constant(_by_fold(out.withColumnRenamed("zone", "fold")))


@case("ols", """with t as (select regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a from lineitem)
    select l_orderkey, l_partkey, l_quantity, l_extendedprice as y_true, round(a + b*l_quantity, 4) as y_pred from lineitem, t""")
def _(v: Views):
    li = v.table("lineitem")
    _, predicted = models.ols(li, li, ["l_quantity"], "l_extendedprice", ["l_orderkey", "l_partkey", "l_quantity"])
    return rounded(predicted, 4, "y_pred")


@case("standardized_model", f"""select cast(0 as bigint) as fold, count(*) as n, round(sum(swe), 3) as truth, true as better
    from {HASH_TEST} where held""")
def _(v: Views):
    out = models.standardized_model(_frame(v), FEATURES, "swe", "ord")
    return _beats_constant(_by_fold(out.withColumn("fold", F.lit(0))))


@case("model_importance", "select cast(4 as bigint) as features, true as shares, 1.0::double as total")
def _(v: Views):
    table = models.fit_importance(_frame(v), FEATURES, "swe")
    return table.agg(F.count("feature").alias("features"), F.bool_and(F.col("importance").between(0, 1)).alias("shares"),
                     F.round(F.sum("importance"), 6).alias("total"))


@case("grid_search", "select unnest([3.0, 5.0])::double as \"maxDepth\", true as better")
def _(v: Views):
    table = models.grid_search(_frame(v), FEATURES, "swe", "station_id", {"maxDepth": [3, 5]}, folds=5)
    spread = v.obs.agg(1.25 * F.stddev_pop("swe")).scalar()
    return table.select("maxDepth", (F.col("rmse") < spread).alias("better"))


@case("ablation", """select m as model, 'station_id' as scheme, count(swe) as n, true as better from obs, (values ('base'), ('weighted')) t(m) group by 1""")
def _(v: Views):
    df = _frame(v)
    weight = 1 + (F.col("lat") - 35) / 50
    weighted = df.withColumns({c: F.col(c) * weight for c in ("altitude", "lon")})
    spread = v.obs.agg(1.25 * F.stddev_pop("swe")).scalar()
    return models.ablation(df, weighted, FEATURES, "swe", "station_id", folds=5).select(
        "model", "scheme", "n", (F.col("rmse") < spread).alias("better"))


@case("complete_analysis", """select scheme, count(swe) as n, true as better from obs, (values ('station'), ('yearly')) t(scheme) group by 1""")
def _(v: Views):
    tables = evaluation.complete_analysis(_frame(v), FEATURES, products=["altitude", "doy"], station_folds=5)
    spread = v.obs.agg(1.25 * F.stddev_pop("swe")).scalar()
    return tables["overall"].select("scheme", "n", (F.col("rmse") < spread).alias("better"))


@case("imputed_model_input", """select count(*) as n, round(sum(coalesce(aspect, (select avg(aspect) from terrain))), 3) as total from terrain""")
def _(v: Views):
    filled = features.impute(v.terrain, ["aspect"], strategy="mean")
    return rounded(filled.agg(F.count("aspect").alias("n"), F.sum("aspect").alias("total")), 3, "total")


@case("repeated_runs", """with s as (select landuse_code as cluster, station_id, altitude, unnest(range(1, 11)) as run from station),
    r as (select *, row_number() over (partition by run, cluster order by md5(cast(run as varchar) || '|' || station_id), station_id) rn, count(*) over (partition by run, cluster) n from s),
    p as (select run, station_id, altitude as x, case when n < 10 then 'train' when rn <= floor(n*0.1::double) then 'test' when rn <= floor(n*0.2::double) then 'valid' else 'train' end as split from r),
    d as (select p.run, p.split, p.x, o.swe as y from p join obs o using (station_id) where o.swe is not null),
    m as (select run, regr_slope(y, x) b, regr_intercept(y, x) a from d where split = 'train' group by 1),
    t as (select d.run, d.y, a + b*d.x as yp from d join m using (run) where d.split = 'test'),
    e as (select run, power(corr(y, yp), 2) as corr2, avg(abs(y - yp)) as mae, sqrt(avg((y - yp)*(y - yp))) as rmse from t group by 1)
    select count(*) as runs, round(avg(corr2), 6) as corr2_mean, round(stddev_pop(corr2), 6) as corr2_std, round(avg(mae), 4) as mae_mean,
    round(stddev_pop(mae), 4) as mae_std, round(avg(rmse), 4) as rmse_mean, round(stddev_pop(rmse), 4) as rmse_std from e""")
def _(v: Views):
    stations = v.station.select("station_id", F.col("landuse_code").alias("cluster"))
    out = models.repeated_runs(_frame(v), ["altitude"], "swe", stations, 10, models.least_squares)
    table = evaluate.run_summary(evaluate.r_squared(out, group=["run"]))
    return rounded(rounded(table, 6, "corr2_mean", "corr2_std"), 4, "mae_mean", "mae_std", "rmse_mean", "rmse_std")


def _cv(fold: str) -> str:
    return f"""{fold}, m as (select k.fold, regr_slope(d.y, d.x) b, regr_intercept(d.y, d.x) a from (select distinct fold from d) k join d on d.fold <> k.fold group by 1)
    select d.fold, round(avg(abs(y - (a + b*x))), 4) as mae, round(sqrt(avg((y - (a + b*x))*(y - (a + b*x)))), 4) as rmse, round(corr(y, a + b*x), 6) as r, count(*) as n
    from d join m using (fold) group by 1"""


STATION_SUMS = """d as (select o.station_id, s.altitude as x, o.swe as y from obs o join station s using (station_id) where o.swe is not null),
    g as (select station_id, count(*) n, sum(x) sx, sum(y) sy, sum(x*x) sxx, sum(x*y) sxy from d group by 1),
    t as (select sum(n) n, sum(sx) sx, sum(sy) sy, sum(sxx) sxx, sum(sxy) sxy from g),
    r as (select station_id, t.n - g.n as n, t.sx - g.sx as sx, t.sy - g.sy as sy, t.sxx - g.sxx as sxx, t.sxy - g.sxy as sxy from g, t),
    m as (select station_id, (n*sxy - sx*sy)/(n*sxx - sx*sx) as b, (sy - (n*sxy - sx*sy)/(n*sxx - sx*sx)*sx)/n as a from r)"""


@case("logo_cv_ols", f"""with {STATION_SUMS} select d.station_id as fold, count(*) as n, round(avg(abs(y - (a + b*x))), 2) as mae,
    round(sqrt(avg((y - (a + b*x))*(y - (a + b*x)))), 2) as rmse from d join m using (station_id) group by 1""")
def _(v: Views):
    out = models.leave_one_group_out_ols(_frame(v), ["altitude"], "swe", "station_id")
    table = models.cross_validation_report(out)["folds"].select("fold", "n", "mae", "rmse")
    return rounded(table, 2, "mae", "rmse")


@case("yearly_cv_ols", _cv("with d as (select year(o.date) as fold, s.altitude as x, o.swe as y from obs o join station s using (station_id) where o.swe is not null)"))
def _(v: Views):
    out = models.leave_one_group_out(_frame(v), ["altitude"], "swe", "year", models.least_squares)
    table = models.cross_validation_report(out)["folds"].select("fold", "mae", "rmse", "r", "n")
    return rounded(rounded(table, 4, "mae", "rmse"), 6, "r")


@case("group_cv_ols", _cv("""with k as (select station_id, (row_number() over (order by md5(station_id), station_id) - 1) % 5 as fold from (select distinct station_id from obs where swe is not null)),
    d as (select k.fold, s.altitude as x, o.swe as y from obs o join station s using (station_id) join k using (station_id) where o.swe is not null)"""))
def _(v: Views):
    out = models.group_k_fold(_frame(v), ["altitude"], "swe", "station_id", 5, models.least_squares)
    table = models.cross_validation_report(out)["folds"].select("fold", "mae", "rmse", "r", "n")
    return rounded(rounded(table, 4, "mae", "rmse"), 6, "r")
