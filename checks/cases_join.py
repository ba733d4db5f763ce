"""Wide table and enrichment joins."""

from pyspark.sql import functions as F

from checks.base import Views, case, rounded
from checks.cases_calendar import hd, hy
from stationloom.functions import calendar as cal
from stationloom.operators import integrate, normalize, quality
from stationloom.operators.integrate import Part
from stationloom.plans import fusion
from stationloom.sources.spec import SourceSpec

WIDE = """with o1 as (select * from (select *, row_number() over (partition by station_id, date order by ord) rn from obs)
    where rn = 1),
    idx as (select station_id, date from dyn_cswe union select station_id, date from obs),
    wide as (select idx.station_id, idx.date, round(c.value, 6) as cswe, o1.swe, t.aspect as terrain_aspect,
        t.slope as terrain_slope, s.altitude from idx
        left join dyn_cswe c on c.station_id = idx.station_id and c.date = idx.date
        left join o1 on o1.station_id = idx.station_id and o1.date = idx.date
        left join terrain t on t.station_id = idx.station_id
        left join station s on s.station_id = idx.station_id)"""


def _sources(v: Views):
    return {"cswe": (SourceSpec("cswe"), v.dyn_cswe),
            "terrain": (SourceSpec("terrain", kind="static", values=("aspect", "slope")), v.terrain)}


def _wide(v: Views):
    return integrate.wide_table(_sources(v), v.obs, "ord", v.station.select("station_id", "altitude"))


@case("wide_table", f"{WIDE} select * from wide")
def _(v: Views):
    return rounded(_wide(v), 6, "cswe")


@case("wide_table_calendar", f"""{WIDE} select *, {hy('date')} as hydrological_year, {hd('date')} as hydrological_doy,
    month(date) as month from wide""")
def _(v: Views):
    wide = fusion.fuse(_sources(v), v.obs, "ord", v.station.select("station_id", "altitude"), calendar=False)
    return rounded(wide, 6, "cswe").withColumns({
        "hydrological_year": cal.hydro_year(F.col("date")), "hydrological_doy": cal.hydro_doy(F.col("date")),
        "month": F.month("date")})


@case("wide_fill_rates", f"""{WIDE} select 'cswe' as "column", count(cswe) as filled, count(*) as records,
    round(100.0::double*count(cswe)/count(*), 6) as fill_pct from wide
    union all select 'swe', count(swe), count(*), round(100.0::double*count(swe)/count(*), 6) from wide
    union all select 'terrain_aspect', count(terrain_aspect), count(*), round(100.0::double*count(terrain_aspect)/count(*), 6) from wide""")
def _(v: Views):
    return rounded(quality.fill_rates(_wide(v), ["cswe", "swe", "terrain_aspect"]), 6, "fill_pct")


@case("master_index", "select station_id, date from dyn_cswe union select station_id, date from obs union select station_id, date from phen")
def _(v: Views):
    return integrate.master_index([v.dyn_cswe, v.obs, v.phen])


@case("phenology_join", """with p as (select station_id, date, min(value) filter (rs = 1) as scp_start, min(value) filter (re = 1) as scp_end
    from (select *, row_number() over (partition by station_id, date, dataset_type order by event_id) r,
    case when dataset_type = 'click' then row_number() over (partition by station_id, date, dataset_type order by event_id) end rs,
    case when dataset_type = 'view' then row_number() over (partition by station_id, date, dataset_type order by event_id) end re
    from phen) group by 1, 2),
    g as (select * from (select station_id, date, value, row_number() over (partition by station_id, date order by event_id) r from phen) where r = 1),
    idx as (select distinct station_id, date from phen where dataset_type = 'error')
    select idx.station_id, idx.date, scp_start, scp_end, g.value as gldas from idx
    left join p on p.station_id = idx.station_id and p.date = idx.date
    left join g on g.station_id = idx.station_id and g.date = idx.date""")
def _(v: Views):
    # start and end share a date, so they are two columns before the join
    p = v.phen
    start, end = p.where("dataset_type = 'click'"), p.where("dataset_type = 'view'")
    return integrate.merge_parts([
        Part(p.where("dataset_type = 'error'")), Part(start, {"scp_start": "value"}, "event_id", index=False),
        Part(end, {"scp_end": "value"}, "event_id", index=False), Part(p, {"gldas": "value"}, "event_id", index=False)])


@case("static_outer_combine", """select coalesce(a.station_id, b.station_id) as station_id, a.aspect, b.supply from
    (select station_id, aspect from terrain where aspect is not null) a full outer join
    (select cast(s_suppkey*3 as varchar) station_id, s_acctbal as supply from supplier) b on a.station_id = b.station_id""")
def _(v: Views):
    other = v.table("supplier").select((F.col("s_suppkey") * 3).cast("string").alias("station_id"),
                                       F.col("s_acctbal").alias("supply"))
    return integrate.combine_static([Part(v.terrain.where("aspect is not null"), {"aspect": "aspect"}),
                                     Part(other, {"supply": "supply"})])


@case("fuse_bbox", """select d.station_id, d.date, d.value as cswe, s.lon as longitude, s.lat as latitude from dyn_cswe d
    join station s using (station_id) where s.lon between 80 and 110 and s.lat between 25 and 45""")
def _(v: Views):
    place = v.station.select("station_id", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    return fusion.fuse({"cswe": (SourceSpec("cswe"), v.dyn_cswe)}, coordinates=[place],
                       station_rule="bbox:80,25,110,45", calendar=False)


@case("whole_rows_merge", """with r as (select l_orderkey as station_id, l_quantity as q, l_extendedprice as p,
    row_number() over (partition by l_orderkey order by l_quantity, l_extendedprice) as rn from lineitem)
    select cast(station_id as varchar) as station_id, q as pair_q, p as pair_p from r where rn = 1""")
def _(v: Views):
    rows = v.table("lineitem").select(F.col("l_orderkey").cast("string").alias("station_id"),
                                      F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    return integrate.combine_static([Part(rows, {"pair_q": "q", "pair_p": "p"})])


@case("static_only_combine", """with y as (select station_id, year(date) as year, max(swe) as peak from obs group by 1, 2)
    select coalesce(y.station_id, t.station_id) as station_id, y.year, y.peak, t.slope from y full outer join
    terrain t on t.station_id = y.station_id""")
def _(v: Views):
    yearly = v.obs.groupBy("station_id", F.year("date").alias("year")).agg(F.max("swe").alias("peak"))
    return integrate.wide_table({
        "slope": (SourceSpec("slope", kind="static", values=("slope",)), v.terrain),
        "peak": (SourceSpec("peak", kind="yearly", values=("peak",)), yearly)})


@case("yearly_join", """with y as (select station_id, year, max(value) as cover from dyn_temp group by 1, 2)
    select o.ord, o.station_id, year(o.date) as year, round(y.cover, 6) as cover from obs o left join y
    on y.station_id = o.station_id and y.year = year(o.date)""")
def _(v: Views):
    yearly = v.dyn_temp.groupBy("station_id", "year").agg(F.max("value").alias("cover"))
    df = v.obs.select("ord", "station_id", F.year("date").alias("year"))
    return rounded(integrate.left_lookup(df, yearly, ["station_id", "year"]), 6, "cover")


@case("yearly_join_first", """with y as (select station_id, year, max(value) as cover from dyn_temp group by 1, 2),
    f as (select * from (select *, row_number() over (partition by station_id order by year) r from y) where r = 1)
    select o.ord, o.station_id, round(f.cover, 6) as cover from obs o left join f on f.station_id = o.station_id""")
def _(v: Views):
    yearly = v.dyn_temp.groupBy("station_id", "year").agg(F.max("value").alias("cover"))
    return rounded(integrate.first_per_station(v.obs.select("ord", "station_id"), yearly, ["cover"], ["year"]), 6, "cover")


@case("multi_source_inner", """with a as (select station_id, date, max(swe) as swe_sat from obs group by 1, 2)
    select round(s.lat, 6) as latitude, round(s.lon, 6) as longitude, a.date, a.swe_sat, round(c.value, 6) as swe_model, s.altitude
    from a join station s using (station_id) join dyn_cswe c on c.station_id = a.station_id and c.date = a.date""")
def _(v: Views):
    at = v.station.select("station_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    sat = v.obs.groupBy("station_id", "date").agg(F.max("swe").alias("swe_sat")).join(at, "station_id").drop("station_id")
    model = v.dyn_cswe.withColumnRenamed("value", "swe_model").join(at, "station_id").drop("station_id")
    ground = v.station.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "altitude")
    return rounded(integrate.inner_by_location([sat, model], ground), 6, "swe_model")


@case("overwrite_protected", """with b as (select * from (select station_id, date, swe, row_number() over (partition by station_id, date order by ord) r from obs) where r = 1),
    f as (select * from (select station_id, date, value, row_number() over (partition by station_id, date order by value) r from dyn_cswe) where r = 1)
    select b.station_id, b.date, round(coalesce(case when f.value <= 150 then f.value end, b.swe), 6) as swe from b
    left join f on f.station_id = b.station_id and f.date = b.date""")
def _(v: Views):
    ref = v.dyn_cswe.select("station_id", "date", "value", F.when(F.col("value") <= 150, F.col("value")).alias("swe"))
    out = integrate.overwrite_protected(v.obs, ref, ["swe"], ["ord"], ["value"])
    return rounded(out.select("station_id", "date", "swe"), 6, "swe")


@case("coord_backfill", """with a as (select station_id, lon, lat from station where zone = 'BUILDING'),
    b as (select cast(s_suppkey*2 as varchar) station_id, cast(s_nationkey as double) lon, s_acctbal lat from supplier)
    select o.station_id, coalesce(a.lon, b.lon) as longitude, coalesce(a.lat, b.lat) as latitude
    from (select distinct station_id from obs) o left join a using (station_id) left join b using (station_id)""")
def _(v: Views):
    first = v.station.where("zone = 'BUILDING'").select("station_id", F.col("lon").alias("longitude"),
                                                  F.col("lat").alias("latitude"))
    second = v.table("supplier").select((F.col("s_suppkey") * 2).cast("string").alias("station_id"),
                                        F.col("s_nationkey").cast("double").alias("longitude"),
                                        F.col("s_acctbal").alias("latitude"))
    return integrate.backfill_coordinates(v.obs.select("station_id").distinct(), [first, second])


@case("station_latest", "select station_id, date, swe, ord from (select *, row_number() over (partition by station_id order by date desc, ord desc) r from obs) where r = 1")
def _(v: Views):
    return integrate.latest_per_station(v.obs, ["date", "ord"])


@case("station_latest_selfjoin", "select o.station_id, o.date, o.ord from obs o join (select station_id, max(date) d from obs group by 1) m on m.station_id = o.station_id and m.d = o.date")
def _(v: Views):
    return integrate.all_at_latest_date(v.obs).select("station_id", "date", "ord")


@case("keep_first", "select station_id, date, swe, ord from (select *, row_number() over (partition by station_id, date order by ord) r from obs) where r = 1")
def _(v: Views):
    return normalize.keep_first(v.obs, ["station_id", "date"], ["ord"])


@case("stations_missing", "select station_id from station where station_id not in (select station_id from phen)")
def _(v: Views):
    return integrate.missing_stations(v.station, v.phen)


@case("stations_in_set", "select station_id, date, event_id from phen where station_id in (select station_id from terrain where aspect > 180)")
def _(v: Views):
    from stationloom.sources.readers import only_ids

    return only_ids(v.phen, v.terrain.where("aspect > 180")).select("station_id", "date", "event_id")


@case("station_match", """with a as (select distinct station_id from phen), b as (select cast(s_suppkey*3 as varchar) station_id from supplier)
    select (select count(*) from a where station_id in (select station_id from b)) as common,
    (select count(*) from a where station_id not in (select station_id from b)) as only_left,
    (select count(*) from b where station_id not in (select station_id from a)) as only_right""")
def _(v: Views):
    return integrate.station_match(v.phen, v.table("supplier").select((F.col("s_suppkey") * 3).cast("string").alias("station_id")))


@case("station_sets", """select station_id, 'both' as part from (select station_id from phen intersect select station_id from obs)
    union all select station_id, 'obs_only' from (select station_id from obs except select station_id from phen)""")
def _(v: Views):
    a, b = v.phen.select("station_id"), v.obs.select("station_id")
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(b.subtract(a).withColumn("part", F.lit("obs_only")))


@case("complete_static", "select d.station_id, t.aspect, t.slope from (select station_id from phen union select station_id from obs) d left join terrain t using (station_id)")
def _(v: Views):
    return integrate.complete_static([v.phen, v.obs], v.terrain)


@case("rep_date_per_year", """with y as (select s.station_id, t.yr as year from station s, (select unnest([2011, 2014, 2017]) yr) t),
    m as (select station_id, year(date) as year, min(date) d from obs group by 1, 2)
    select y.station_id, cast(y.year as bigint) as year, coalesce(m.d, make_date(y.year, 6, 15)) as date from y left join m on m.station_id = y.station_id and m.year = y.year""")
def _(v: Views):
    years = v.station.select("station_id", F.explode(F.array(F.lit(2011), F.lit(2014), F.lit(2017))).alias("year"))
    return integrate.representative_dates(years, v.obs)


@case("extracted_value_join", "select o.ord, o.station_id, o.date, round(c.value, 6) as value from obs o left join dyn_cswe c on c.station_id = o.station_id and c.date = o.date")
def _(v: Views):
    return rounded(integrate.attach_extracted(v.obs.drop("swe"), v.dyn_cswe, "value", ["value"]), 6, "value")


@case("cluster_lookup", """with c as (select station_id, landuse_code as cluster from station where zone <> 'MACHINERY')
    select o.ord, coalesce(c.cluster, (select max(cluster) + 1 from c)) as cluster from obs o left join c using (station_id)""")
def _(v: Views):
    clusters = v.station.where("zone <> 'MACHINERY'").select("station_id", F.col("landuse_code").alias("cluster"))
    return integrate.attach_cluster(v.obs.select("ord", "station_id"), clusters).select("ord", "cluster")


@case("weight_rows_join", "select s.num as id, s.lon, round(w.weights[1], 9) as first_weight from station s left join weights w on w.id = s.num")
def _(v: Views):
    rows = v.station.select(F.col("num").alias("id"), "lon")
    joined = integrate.attach_by_id(rows, v.weights.select("id", "weights"))
    return joined.select("id", "lon", F.round(F.col("weights")[0], 9).alias("first_weight"))


@case("temporal_overlap", """with o as (select ord, swe, year(date) as year, date from obs)
    select ord, year from o where year between (select min(year) from o where swe > 499.5)
    and (select max(year) from o where swe > 499.5 and date < date '2016-01-01')""")
def _(v: Views):
    o = v.obs.select("ord", "swe", "date", F.year("date").alias("year"))
    held = o.where("swe > 499.5 and date < date '2016-01-01'")
    return integrate.within_year_range(o, held).select("ord", "year")


@case("long_union", """select 'obs' as source, station_id, date, swe, null::double as value from obs
    union all select 'cswe', station_id, date, null, round(value, 6) from dyn_cswe
    union all select 'phen', station_id, date, null, value from phen""")
def _(v: Views):
    out = integrate.stack_sources({"obs": v.obs.drop("ord"), "cswe": v.dyn_cswe,
                                   "phen": v.phen.drop("dataset_type", "event_id")})
    return rounded(out, 6, "value")


@case("sorted_output", "select station_id, date, ord from obs order by station_id, date, ord")
def _(v: Views):
    return v.obs.select("station_id", "date", "ord").orderBy("station_id", "date", "ord")
