"""Coverage, distribution, consistency and duplicates."""

import uuid

from pyspark.sql import functions as F

from checks.base import Views, case, rounded
from stationloom.functions import calendar as cal
from stationloom.operators import quality
from stationloom.session import ensure_checkpoint_dir
from stationloom.sources import writers
from stationloom.sources.spec import TERRAIN_FEATURES


@case("station_coverage", "select station_id, count(*) as records, count(swe) as valid, round(100.0::double*count(swe)/count(*), 6) as coverage_pct from obs group by 1")
def _(v: Views):
    return rounded(quality.station_coverage(v.obs), 6, "coverage_pct")


@case("overall_coverage", """with p as (select station_id, count(*) n, count(swe) s, 100.0::double*count(swe)/count(*) c from obs group by 1)
    select count(*) as stations, cast(sum(n) as bigint) as records, cast(sum(s) as bigint) as valid, round(avg(n), 6) as avg_records, round(avg(c), 6) as avg_coverage_pct from p""")
def _(v: Views):
    return rounded(quality.overall_coverage(v.obs), 6, "avg_records", "avg_coverage_pct")


@case("coverage_ranking", "select station_id, count(*) as records, count(swe) as valid from obs group by 1 order by count(*) desc, station_id limit 20")
def _(v: Views):
    per = quality.station_coverage(v.obs).select("station_id", "records", "valid")
    return per.orderBy(F.desc("records"), "station_id").limit(20)


@case("station_time_coverage", """select station_id, min(date) as first_date, max(date) as last_date, count(*) as records,
    min(year(date)) as min_year, max(year(date)) as max_year, count(distinct year(date)) as n_years,
    count(distinct month(date)) as n_months from obs group by 1""")
def _(v: Views):
    return quality.station_time_coverage(v.obs)


@case("station_year_coverage", "select station_id, min(year(date)) as min_year, max(year(date)) as max_year, count(distinct year(date)) as n_years from obs group by 1")
def _(v: Views):
    return quality.station_year_coverage(v.obs)


@case("time_distribution", """select 'year' as level, cast(year(date) as varchar) as period, count(*) as records from obs group by 2
    union all select 'month', cast(month(date) as varchar), count(*) from obs group by 2
    union all select 'year_month', strftime(date, '%Y-%m'), count(*) from obs group by 2""")
def _(v: Views):
    return quality.time_distribution(v.obs)


@case("swe_by_month", "select strftime(date, '%Y-%m') as year_month, count(distinct station_id) as stations, count(*) as records from obs where swe is not null group by 1")
def _(v: Views):
    return quality.value_by_month(v.obs)


@case("date_validity", """with d as (select case when ord % 9 = 0 then null else date end as date from obs)
    select count(*) as records, count(date) as valid_dates, min(date) as first_date, max(date) as last_date, round(100.0::double*count(date)/count(*), 6) as valid_pct from d""")
def _(v: Views):
    df = v.obs.withColumn("date", F.when(F.col("ord") % 9 != 0, F.col("date")))
    return rounded(quality.date_validity(df), 6, "valid_pct")


@case("time_summary", """select count(distinct station_id) as stations, count(*) as records, count(swe) as valid_values, min(date) as first_date,
    max(date) as last_date, round(count(*)/cast(count(distinct station_id) as double), 6) as avg_records, round(100.0::double*count(swe)/count(*), 6) as coverage_pct from obs""")
def _(v: Views):
    return rounded(quality.time_summary(v.obs), 6, "avg_records", "coverage_pct")


@case("class_distribution", """with z as (select case when num % 13 = 0 then null else landuse_code end as code from station)
    select code, count(*) as records, round(100.0::double*count(*)/sum(count(*)) over (), 6) as pct from z group by 1""")
def _(v: Views):
    df = v.station.select(F.when(F.col("num") % 13 != 0, F.col("landuse_code")).alias("code"))
    return rounded(quality.class_distribution(df, "code"), 6, "pct")


@case("top_classes", "select landuse_code, count(*) as records from station group by 1 order by 2 desc, 1 limit 5")
def _(v: Views):
    per = quality.class_distribution(v.station, "landuse_code").select("landuse_code", "records")
    return per.orderBy(F.desc("records"), "landuse_code").limit(5)


@case("fill_rates", " union all ".join(
    f"select '{c}' as \"column\", count({c}) as filled, count(*) as records, round(100.0::double*count({c})/count(*), 6) as fill_pct from obs"
    for c in ("station_id", "date", "swe")))
def _(v: Views):
    return rounded(quality.fill_rates(v.obs, ["station_id", "date", "swe"]), 6, "fill_pct")


@case("all_null_rows", "select count(*) as records, cast(sum(case when aspect is null and slope is null then 1 else 0 end) as bigint) as all_null from terrain")
def _(v: Views):
    return quality.all_null_rows(v.terrain, ["aspect", "slope"])


@case("consistency", """with p as (select station_id, count(distinct swe) <= 1 a, count(distinct year(date)) <= 1 b from obs group by 1)
    select 'swe' as "column", count(*) filter (a) as consistent, count(*) as stations, round(100.0::double*count(*) filter (a)/count(*), 6) as pct from p
    union all select 'year', count(*) filter (b), count(*), round(100.0::double*count(*) filter (b)/count(*), 6) from p""")
def _(v: Views):
    df = v.obs.withColumn("year", F.year("date"))
    return rounded(quality.consistency(df, ["swe", "year"]), 6, "pct")


@case("full_coverage", "select station_id, count(swe) = count(*) as \"full\", count(swe) > 0 as \"any\" from obs group by 1")
def _(v: Views):
    return quality.station_fill(v.obs, "swe")


@case("station_means", "select station_id, round(avg(swe), 9) as swe, round(avg(ord), 9) as ord from obs group by 1")
def _(v: Views):
    return rounded(quality.station_means(v.obs, ["swe", "ord"]), 9, "swe", "ord")


@case("static_altitude", "select cast(landuse_code as varchar) as station_id, round(avg(altitude), 6) as altitude from station group by 1")
def _(v: Views):
    df = v.station.select(F.col("landuse_code").cast("string").alias("station_id"), "altitude")
    return rounded(quality.station_means(df, ["altitude"]), 6, "altitude")


@case("value_summary", "select count(swe) as n, min(swe) as min, max(swe) as max, round(avg(swe), 6) as mean, round(median(swe), 6) as median, round(stddev_samp(swe), 6) as std from obs")
def _(v: Views):
    return rounded(quality.value_summary(v.obs, "swe"), 6, "mean", "median", "std")


@case("value_summary_by_station", "select station_id, count(swe) as n, min(swe) as min, max(swe) as max, round(avg(swe), 9) as mean, round(median(swe), 9) as median, round(stddev_samp(swe), 6) as std from obs group by 1")
def _(v: Views):
    return rounded(quality.value_summary(v.obs, "swe", ["station_id"]), 9, "mean", "median").withColumn("std", F.round("std", 6))


@case("phenology_pivot", """select month(date) as period, count(*) filter (dataset_type = 'click') as click, count(*) filter (dataset_type = 'view') as view,
    count(*) filter (dataset_type = 'none') as none from phen group by 1""")
def _(v: Views):
    return quality.pivot_counts(v.phen.withColumn("period", F.month("date")), "period", "dataset_type",
                                ["click", "view", "none"])


@case("feature_pivot", "select station_id, " + ", ".join(
    f"max(case when f = {i} then altitude end) as {n}" for i, n in enumerate(TERRAIN_FEATURES)) +
    " from (select cast(landuse_code as varchar) station_id, num % 14 f, altitude from station) group by 1")
def _(v: Views):
    names = F.array(*[F.lit(n) for n in TERRAIN_FEATURES])
    tall = v.station.select(F.col("landuse_code").cast("string").alias("station_id"),
                            F.get(names, (F.col("num") % 14).cast("int")).alias("feature"),
                            F.col("altitude").alias("value"))
    return quality.features_wide(tall, TERRAIN_FEATURES)


@case("sample_size_hist", """with p as (select station_id, count(*) n from phen group by 1 union all select station_id, count(*) from obs group by 1)
    select case when n = 1 then '1' when n = 2 then '2' when n = 3 then '3' when n <= 10 then '4-10' when n <= 50 then '11-50'
    when n <= 100 then '51-100' else '>100' end as size_class, count(*) as stations, cast(sum(n) as bigint) as samples from p group by 1""")
def _(v: Views):
    rows = v.phen.select(F.concat(F.lit("p"), "station_id").alias("station_id")).unionByName(v.obs.select("station_id"))
    return quality.sample_size_histogram(rows)


@case("small_station_share", """with p as (select station_id, count(*) n from obs group by 1)
    select count(*) as stations, count(*) filter (n <= 7) as small_stations, cast(sum(n) as bigint) as samples,
    cast(sum(n) filter (n <= 7) as bigint) as small_samples, round(100.0::double*count(*) filter (n <= 7)/count(*), 6) as small_station_pct,
    round(100.0::double*sum(n) filter (n <= 7)/sum(n), 6) as small_sample_pct from p""")
def _(v: Views):
    return rounded(quality.small_station_share(v.obs, 7), 6, "small_station_pct", "small_sample_pct")


@case("duplicates", """with d as (select station_id, date, count(*) c from obs group by 1, 2 having count(*) > 1),
    n as (select *, row_number() over (order by station_id, date) - 1 as duplicate_group from d)
    select o.station_id, o.date, o.ord, n.c as copies, n.duplicate_group from obs o join n on n.station_id = o.station_id and n.date = o.date""")
def _(v: Views):
    return quality.duplicate_rows(v.obs.select("station_id", "date", "ord"))


@case("duplicates_missing_keys", """with o as (select case when ord % 3 = 0 then null else station_id end as station_id,
    case when ord % 5 = 0 then null else date end as date, ord from obs),
    d as (select station_id, date, count(*) c from o group by 1, 2 having count(*) > 1),
    n as (select *, row_number() over (order by station_id nulls first, date nulls first) - 1 as duplicate_group from d)
    select o.station_id, o.date, o.ord, n.c as copies, n.duplicate_group from o join n on n.station_id is not distinct from o.station_id
    and n.date is not distinct from o.date""")
def _(v: Views):
    holes = v.obs.select(F.when(F.col("ord") % 3 != 0, F.col("station_id")).alias("station_id"),
                         F.when(F.col("ord") % 5 != 0, F.col("date")).alias("date"), "ord")
    return quality.duplicate_rows(holes)


@case("duplicate_count", "select count(*) as records, count(distinct (station_id, date)) as keys, count(*) - count(distinct (station_id, date)) as duplicates from obs")
def _(v: Views):
    return quality.duplicate_count(v.obs)


@case("source_inventory", """select 'obs' as source, count(*) as records, count(distinct station_id) as stations, count(distinct date) as dates from obs
    union all select 'phen', count(*), count(distinct station_id), count(distinct date) from phen
    union all select 'cswe', count(*), count(distinct station_id), count(distinct date) from dyn_cswe""")
def _(v: Views):
    return quality.source_inventory({"obs": v.obs, "phen": v.phen, "cswe": v.dyn_cswe})


@case("integrity", """with x as (select *, dayofyear(make_date(year(date), 12, 31)) = 366 as leap, abs(dayofyear(date) - 172) as near from obs)
    select count(*) as rows, count(distinct station_id) as stations, min(date) as first_date, max(date) as last_date,
    count(*) - count(distinct (station_id, date)) as duplicates, round(100.0::double*count(*) filter (leap)/count(*), 6) as leap_pct,
    round(avg(near), 6) as nearest_mean, min(near) as nearest_min, max(near) as nearest_max, round(100.0::double*count(swe)/count(*), 6) as swe_pct from x""")
def _(v: Views):
    df = v.obs.withColumns({"is_leap_year": cal.is_leap(F.year("date")), "near": F.abs(F.dayofyear("date") - 172)})
    return rounded(quality.integrity(df, ["swe"], nearest="near"), 6, "leap_pct", "nearest_mean", "swe_pct")


@case("processing_yield", """with s as (select cast(unnest(generate_series(timestamp '2011-01-01', timestamp '2017-12-31', interval 1 day)) as date) as date),
    l as (select distinct date from obs where swe is not null)
    select count(*) as requested, count(l.date) as done, count(*) - count(l.date) as failed, round(100.0::double*count(l.date)/count(*), 6) as success_pct
    from s left join l on l.date = s.date""")
def _(v: Views):
    from stationloom.sources.readers import date_spine

    bounds = v.obs.select(F.lit("2011-01-01").alias("start"), F.lit("2017-12-31").alias("end")).limit(1)
    return rounded(quality.processing_yield(date_spine(bounds), v.obs.where("swe is not null")), 6, "success_pct")


@case("station_fill_nulls", """with f as (select *, row_number() over (partition by station_id order by ord) r from obs where swe is not null)
    select o.ord, coalesce(o.swe, f.swe) as swe from obs o left join f on f.station_id = o.station_id and f.r = 1""")
def _(v: Views):
    return quality.fill_station_nulls(v.obs, ["swe"], "ord").select("ord", "swe")


@case("quality_sheets", """select station_id, count(*) as records, round(100.0::double*count(swe)/count(*), 6) as coverage_pct,
    min(date) as first_date, max(date) as last_date from obs group by 1""")
def _(v: Views):
    from stationloom.plans.fusion import reports

    sheets = reports(v.obs)
    joined = sheets["station_coverage"].join(sheets["station_time_coverage"].drop("records"), "station_id")
    return rounded(joined.select("station_id", "records", "coverage_pct", "first_date", "last_date"), 6, "coverage_pct")


def _published(v: Views, outputs: dict) -> str:
    folder = f"{ensure_checkpoint_dir(v.spark)}/published-{uuid.uuid4().hex}"
    writers.publish(outputs, folder, v.spark)
    return folder


@case("published_period", """select 'parquet' as format, ord, station_id, date, swe from obs
    union all select 'csv', ord, station_id, date, swe from obs""")
def _(v: Views):
    folder = _published(v, writers.period_outputs(
        v.obs.select("ord", "station_id", "date", "swe"), "obs", "1992-01-01", "1998-12-31"))
    parts = [writers.read_published(v.spark, folder, f"obs_19920101_19981231.{f}").withColumn("format", F.lit(f))
             for f in ("parquet", "csv")]
    return parts[0].unionByName(parts[1])


@case("published_sheets", """with s as (select station_id, count(*) as records, count(swe) as valid, min(date) as first_date, max(date) as last_date from obs group by 1),
    o as (select count(*) as stations, cast(sum(records) as bigint) as all_records, cast(sum(valid) as bigint) as valid_values from s)
    select station_id, records, round(100.0::double*valid/records, 6) as coverage_pct, first_date, last_date, stations, all_records, valid_values from s, o""")
def _(v: Views):
    from stationloom.plans.fusion import reports

    folder = _published(v, writers.sheet_outputs(reports(v.obs)))
    sheets = {name: writers.read_published(v.spark, folder, name) for name in writers.published_names(v.spark, folder)}
    overall = sheets["overall_coverage"].select(F.struct("*")).scalar()
    joined = sheets["station_coverage"].join(sheets["station_time_coverage"].drop("records"), "station_id")
    return rounded(joined.select("station_id", "records", "coverage_pct", "first_date", "last_date", overall["stations"].alias("stations"),
                                 overall["records"].alias("all_records"), overall["valid"].alias("valid_values")), 6, "coverage_pct")


@case("published_evaluation", """with p as (select fold, count(*) as records, sum(y_true) as total from pred group by 1),
    a as (select count(*) as all_records from pred)
    select fold, records, round(total, 2) as total, all_records from p, a""")
def _(v: Views):
    by_fold = v.pred.groupBy("fold").agg(F.count(F.lit(1)).alias("records"))
    total = v.pred.agg(F.count(F.lit(1)).alias("all_records"))
    folder = _published(v, writers.evaluation_outputs(v.pred.select("fold", "y_true"), by_fold, by_fold.limit(0), total))
    predictions, folds, summary = (writers.read_published(v.spark, folder, n) for n in ("predictions", "folds", "summary"))
    sums = predictions.groupBy("fold").agg(F.round(F.sum("y_true"), 2).alias("total"))
    return folds.join(sums, "fold").withColumn("all_records", summary.scalar())
