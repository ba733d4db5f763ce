"""Training splits."""

from pyspark.sql import functions as F

from checks.base import Views, case
from stationloom.operators import splits

RANK = "row_number() over (order by md5({k}), {k}) rn, count(*) over () n"


@case("split_station", f"""with r as (select station_id, {RANK.format(k='station_id')} from (select distinct station_id from obs))
    select station_id, case when rn <= floor(n*0.75::double) then 'train' when rn <= floor(n*0.75::double) + floor(n*0.1::double) then 'valid' else 'test' end as split from r""")
def _(v: Views):
    return splits.split_stations(v.obs)


@case("split_hold_out", f"""with r as (select station_id, {RANK.format(k='station_id')} from (select distinct station_id from obs))
    select station_id, case when rn <= floor(n*0.1::double) then 'test' else 'train' end as split from r""")
def _(v: Views):
    return splits.hold_out_stations(v.obs)


CLUSTER = """case when n < 60 then 'train' when rn <= floor(n*0.1::double) then 'test' when rn <= floor(n*0.2::double) then 'valid' else 'train' end as split"""


@case("split_cluster", f"""with r as (select landuse_code as cluster, station_id, row_number() over (partition by landuse_code order by md5(station_id), station_id) rn,
    count(*) over (partition by landuse_code) n from station) select cluster, station_id, {CLUSTER} from r""")
def _(v: Views):
    return splits.split_clusters(v.station.select(F.col("landuse_code").alias("cluster"), "station_id"), small=60)


@case("split_runs", """with s as (select landuse_code as cluster, station_id, unnest(range(1, 11)) as run from station),
    r as (select *, row_number() over (partition by run, cluster order by md5(cast(run as varchar) || '|' || station_id), station_id) rn, count(*) over (partition by run, cluster) n from s)
    select run, cluster, station_id, case when n < 10 then 'train' when rn <= floor(n*0.1::double) then 'test' when rn <= floor(n*0.2::double) then 'valid' else 'train' end as split from r""")
def _(v: Views):
    return splits.repeated_splits(v.station.select(F.col("landuse_code").alias("cluster"), "station_id"))


@case("split_time", """with r as (select ord, date, row_number() over (order by date, md5(cast(ord as varchar)), ord) rn, count(*) over () n from obs)
    select ord, date, case when rn > n - floor(n*0.2::double) then 'valid' else 'train' end as split from r""")
def _(v: Views):
    return splits.split_time(v.obs.select("ord", "date"), "ord")


@case("split_zone", f"""with r as (select code as zone, {RANK.format(k='cast(code as varchar)')} from classes)
    select zone, case when rn <= floor(n*0.2::double) then 'test' else 'train' end as split from r""")
def _(v: Views):
    return splits.split_zones(v.station.select(F.col("landuse_code").alias("zone")))


@case("group_kfold", f"""with r as (select station_id, {RANK.format(k='station_id')} from (select distinct station_id from obs))
    select station_id, (rn - 1) % 5 as fold from r""")
def _(v: Views):
    return splits.group_folds(v.obs)
