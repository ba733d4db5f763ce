"""Encoders, imputation, scaling, weighting and recipes."""

import uuid

from pyspark.sql import functions as F

from checks.base import Views, case, rounded
from stationloom.operators import features
from stationloom.operators.quality import onehot_check
from stationloom.plans import recipes
from stationloom.session import ensure_checkpoint_dir

LAND = """with s as (select num, altitude, case when num % 17 = 0 then null else landuse_code end as landuse_code from station)"""


def _land(v: Views):
    return v.station.select("num", "altitude", F.when(F.col("num") % 17 != 0, F.col("landuse_code")).alias("landuse_code"))


def _hash_columns(n: int) -> str:
    h = "md5(coalesce(cast(landuse_code as varchar), 'unknown'))"
    bucket = f"(('0x' || substr({h}, 1, 8))::bigint % {n})"
    sign = f"case when ('0x' || substr({h}, 9, 1))::bigint % 2 = 0 then 1 else -1 end"
    return ", ".join(f"cast(case when {bucket} = {i} then {sign} else 0 end as double) as landuse_hash_{i}"
                     for i in range(n))


@case("onehot", f"{LAND} select num, landuse_code, " + ", ".join(
    f"cast(case when landuse_code = {c} then 1 else 0 end as bigint) as landuse_{c}" for c in range(11, 36)) + " from s")
def _(v: Views):
    return features.one_hot(_land(v), "landuse_code", limit=30).drop("altitude")


@case("onehot_check", f"{LAND} select cast(case when landuse_code between 11 and 30 then 1 else 0 end as bigint) as row_sum, count(*) as records from s group by 1")
def _(v: Views):
    df = features.one_hot(_land(v), "landuse_code", list(range(11, 31)))
    return onehot_check(df, [f"landuse_{c}" for c in range(11, 31)])


@case("hash_encode", f"{LAND} select num, {_hash_columns(10)} from s")
def _(v: Views):
    return features.hash_encode(_land(v)).drop("altitude", "landuse_code")


FREQ = "round(c.n/cast((select count(landuse_code) from s) as double), 9)"


@case("freq_encode", f"""{LAND}, c as (select landuse_code, count(*) n from s where landuse_code is not null group by 1)
    select num, {FREQ} as landuse_code_freq from s left join c using (landuse_code)""")
def _(v: Views):
    return rounded(features.frequency_encode(_land(v)).select("num", "landuse_code_freq"), 9, "landuse_code_freq")


@case("target_encode", f"""{LAND}, c as (select landuse_code, (sum(altitude) + 10*(select avg(altitude) from s))/(count(altitude) + 10) as t from s
    where landuse_code is not null group by 1) select num, round(t, 6) as landuse_code_target from s left join c using (landuse_code)""")
def _(v: Views):
    out = features.target_encode(_land(v), target="altitude").select("num", "landuse_code_target")
    return rounded(out, 6, "landuse_code_target")


@case("composite_encode", f"""{LAND}, c as (select landuse_code, count(*) n from s where landuse_code is not null group by 1)
    select num, {_hash_columns(10)}, {FREQ} as landuse_code_freq from s left join c using (landuse_code)""")
def _(v: Views):
    return rounded(features.composite_encode(_land(v)).drop("altitude", "landuse_code"), 9, "landuse_code_freq")


@case("encoding_advice", f"{LAND} select count(distinct landuse_code) as n_classes, count(*) - count(landuse_code) as missing, 'hash_8_16' as advice from s")
def _(v: Views):
    return features.encoding_advice(_land(v))


IMPUTE = """with x as (select s.num, t.aspect, case when s.num % 41 = 0 then null else s.altitude end as altitude,
    case when s.num % 9 = 0 then null else s.zone end as zone from station s join terrain t using (station_id))"""


def _holes(v: Views):
    df = v.station.join(v.terrain, "station_id")
    return df.select("num", "aspect", F.when(F.col("num") % 41 != 0, F.col("altitude")).alias("altitude"),
                     F.when(F.col("num") % 9 != 0, F.col("zone")).alias("zone"))


@case("impute_auto", f"""{IMPUTE} select num, round(coalesce(aspect, (select avg(aspect) from x)), 6) as aspect,
    round(coalesce(altitude, (select median(altitude) from x)), 6) as altitude,
    coalesce(zone, (select zone from x where zone is not null group by zone order by count(*) desc, zone limit 1)) as zone from x""")
def _(v: Views):
    return rounded(features.impute(_holes(v), ["aspect", "altitude"], ["zone"]), 6, "aspect", "altitude")


@case("impute_replay", f"""{IMPUTE} select num, round(coalesce(aspect, (select median(aspect) from x where altitude > 0)), 6) as aspect,
    coalesce(zone, (select zone from x where zone is not null and altitude > 0 group by zone order by count(*) desc, zone limit 1)) as zone
    from x""")
def _(v: Views):
    df = _holes(v)
    plan = features.fit_missing(df.where("altitude > 0"), ["aspect"], ["zone"], "median")
    return rounded(plan.replay(df.drop("altitude")), 6, "aspect")


@case("scale_minmax", """with t as (select min(altitude) a, max(altitude) b from station where zone <> 'BUILDING')
    select num, round((altitude - a)/(b - a + 1e-8), 9) as altitude from station, t""")
def _(v: Views):
    train = v.station.where("zone <> 'BUILDING'")
    return rounded(features.scale_like(train, v.station.select("num", "altitude"), ["altitude"]), 9, "altitude")


@case("scale_standard", """with t as (select avg(altitude) a, stddev_pop(altitude) b from station where zone <> 'BUILDING')
    select num, round((altitude - a)/(b + 1e-8), 9) as altitude from station, t""")
def _(v: Views):
    train = v.station.where("zone <> 'BUILDING'")
    return rounded(features.scale_like(train, v.station.select("num", "altitude"), ["altitude"], "standard"), 9, "altitude")


@case("weighted_features", """with n as (select vec_id id, embedding, label from embeddings),
    w as (select id, weights from weights where label <> 1)
    select n.id, cast(i - 1 as bigint) as pos, round(cast(n.embedding[i] as double)*coalesce(w.weights[65 - i], 1), 9) as value
    from (select *, unnest(range(1, 65)) i from n) n left join w using (id)""")
def _(v: Views):
    f = v.weights.select("id", F.col("weights").alias("features"))
    w = v.weights.where("label <> 1").select("id", F.reverse("weights").alias("weights"))
    out = features.weighted_features(f, w)
    return rounded(out.select("id", F.posexplode("weighted").alias("pos", "value")), 9, "value")


@case("repair_encode", f"""with o as (select ord, station_id, date, case when ord % 4 = 0 then null else cast(ord % 7 as bigint) end as landuse_code from obs),
    f as (select *, row_number() over (partition by station_id order by ord) r from o where landuse_code is not null),
    s as (select o.ord, o.date, coalesce(o.landuse_code, f.landuse_code) as landuse_code from o left join f on f.station_id = o.station_id and f.r = 1
        where o.date not in (date '2025-10-10', date '2025-10-11'))
    select ord, date, landuse_code, {_hash_columns(10)} from s""")
def _(v: Views):
    df = v.obs.select("ord", "station_id", "date", F.lit("x").alias("landuse_class"),
                      F.when(F.col("ord") % 4 != 0, F.col("ord") % 7).alias("landuse_code"))
    fixed = recipes.Recipe().add("data_fixer", order="ord").add("feature_encoder", "hashing", n_features=10).run(df)
    return fixed.drop("station_id")


@case("repair_only", """with o as (select ord, station_id, date, case when ord % 4 = 0 then null else cast(ord % 7 as bigint) end as landuse_code from obs),
    f as (select *, row_number() over (partition by station_id order by ord) r from o where landuse_code is not null)
    select o.ord, coalesce(o.landuse_code, f.landuse_code) as landuse_code from o left join f on f.station_id = o.station_id and f.r = 1""")
def _(v: Views):
    df = v.obs.select("ord", "station_id", "date", F.when(F.col("ord") % 4 != 0, F.col("ord") % 7).alias("landuse_code"))
    return recipes.Recipe().add("data_fixer", order="ord").run(df).select("ord", "landuse_code")


@case("repair_composite", f"""with o as (select ord, station_id, date, case when ord % 4 = 0 then null else cast(ord % 7 as bigint) end as landuse_code from obs),
    f as (select *, row_number() over (partition by station_id order by ord) r from o where landuse_code is not null),
    s as (select o.ord, coalesce(o.landuse_code, f.landuse_code) as landuse_code from o left join f on f.station_id = o.station_id and f.r = 1),
    c as (select landuse_code, count(*) n from s where landuse_code is not null group by 1)
    select ord, {_hash_columns(10)}, {FREQ} as landuse_code_freq from s left join c using (landuse_code)""")
def _(v: Views):
    df = v.obs.select("ord", "station_id", "date", F.when(F.col("ord") % 4 != 0, F.col("ord") % 7).alias("landuse_code"))
    plan = recipes.Recipe().add("data_analyzer", "basic").add("data_fixer", order="ord").add("feature_encoder", "composite")
    out = plan.run(df).drop("station_id", "date", "landuse_code")
    return rounded(out, 9, "landuse_code_freq")


RECIPE = """with o as (select ord, station_id, date, 'x' as landuse_class, case when ord % 4 = 0 then null else cast(ord % 7 as bigint) end as landuse_code from obs),
    f as (select station_id, min_by(landuse_code, (date, ord)) as first from o where landuse_code is not null and date is not null group by 1),
    s as (select o.ord, o.station_id, o.date, coalesce(o.landuse_code, f.first) as landuse_code from o left join f using (station_id)
        where o.date is null or o.date not in (date '2025-10-10', date '2025-10-11')),
    a as (select count(*) as n, 4 * count(*) - count(ord) - count(station_id) - count(date) - count(landuse_code) as missing from o),
    b as (select count(*) as n, count(*) - count(landuse_code) as unclassed, 3 * count(*) - count(ord) - count(station_id) - count(date) as rest from s)"""
STEPS = """
    select cast(1 as bigint) as position, 'data_analyzer' as step, 'basic' as version, cast(5 as bigint) as columns, n as rows, missing from a
    union all select 2, 'data_fixer', 'v1', 4, n, unclassed + rest from b
    union all select 3, 'feature_encoder', 'composite', 15, n, 2 * unclassed + rest from b"""


def _recipe_input(v: Views):
    return v.obs.select("ord", "station_id", "date", F.lit("x").alias("landuse_class"),
                        F.when(F.col("ord") % 4 != 0, F.col("ord") % 7).alias("landuse_code"))


@case("recipe_observed", RECIPE + STEPS + " union all select 0, 'input', '', 5, n, missing from a")
def _(v: Views):
    summary = recipes.advanced_analysis().observed(
        _recipe_input(v), lambda df: df.write.format("noop").mode("overwrite").save())
    return summary.drop("seconds")


@case("recipe_staged", RECIPE + STEPS)
def _(v: Views):
    folder = f"{ensure_checkpoint_dir(v.spark)}/recipe-{uuid.uuid4().hex}"
    return recipes.advanced_analysis().staged(_recipe_input(v), folder)[1].drop("seconds")


@case("recipe_reports", RECIPE + """,
    r as (select 'landuse_class' as "column", landuse_class as class, count(*) as records from o group by 2
        union all select 'landuse_code', cast(landuse_code as varchar), count(*) from o group by 2),
    p as (select count(*) as records, count(distinct station_id) as stations, count(*) filter (date in (date '2025-10-10', date '2025-10-11')) as bad_dates,
        count(distinct landuse_code) as n_classes, count(*) - count(landuse_code) as missing from o)
    select "column", class, r.records, 100.0 * r.records / p.records as pct, stations, bad_dates, 'landuse_class' as columns_to_drop, n_classes, missing,
        case when n_classes <= 10 then 'onehot' when n_classes <= 50 then 'hash_8_16' else 'hash_16_32' end as advice from r, p""")
def _(v: Views):
    found = recipes.advanced_analysis().reports(_recipe_input(v))
    # these two have one row
    preview, advice = (found[f"1_data_analyzer/{r}"].select(F.struct("*")).scalar() for r in ("repair_preview", "encoding_advice"))
    return found["1_data_analyzer/class_distribution"].withColumns({
        **{c: preview[c] for c in ("stations", "bad_dates", "columns_to_drop")},
        **{c: advice[c] for c in ("n_classes", "missing", "advice")}})
