"""Scans, normalisation, predicates, masks and scalar functions."""

from pyspark.sql import functions as F

from checks.base import Views, case, rounded
from stationloom.functions import geo, scalar
from stationloom.operators import filters, normalize
from stationloom.operators.features import default_columns, feature_columns, physical_features
from stationloom.sources import readers
from stationloom.sources.spec import SENSOR_PRIORITY, SourceSpec


@case("station_scan", """select o_custkey, o_orderdate, o_totalprice from orders
    where o_orderdate between timestamp '1996-01-01' and timestamp '1998-12-31'""")
def _(v: Views):
    return readers.station_scan(v.table("orders"), ["o_custkey", "o_orderdate", "o_totalprice"], "o_orderdate",
                                "1996-01-01", "1998-12-31")


@case("id_list_scan", """select station_id, date, swe, ord from obs
    where station_id in (select cast(s_suppkey as varchar) from supplier)""")
def _(v: Views):
    return readers.only_ids(v.obs, v.table("supplier").select(F.col("s_suppkey").cast("string").alias("station_id")))


FILE_NAME = """case o_orderkey % 3 when 0 then strftime(d, '%Y%m%d') || '_northern_hemisphere_swe_0.25grid.nc'
    when 1 then (case o_custkey % 5 when 0 then 'DMSP_SMMR' when 1 then 'F08_SSMI' when 2 then 'F13_SSMI'
        when 3 then 'F17_SSMIS' else 'F99_OTHER' end) || '_SWE_' || strftime(d, '%Y%m%d') || '_DAILY_025KM_V1.2.h5'
    else 'depth_' || strftime(d, '%Y_%m_%d') || '.txt' end"""


def _files(v: Views):
    d = F.col("o_orderdate").cast("date")
    k = F.col("o_custkey") % 5
    sensor = F.when(k == 0, "DMSP_SMMR").when(k == 1, "F08_SSMI").when(k == 2, "F13_SSMI").when(
        k == 3, "F17_SSMIS").otherwise("F99_OTHER")
    compact = F.date_format(d, "yyyyMMdd")
    kind = F.col("o_orderkey") % 3
    name = F.when(kind == 0, F.concat(compact, F.lit("_northern_hemisphere_swe_0.25grid.nc"))).when(
        kind == 1, F.concat(sensor, F.lit("_SWE_"), compact, F.lit("_DAILY_025KM_V1.2.h5"))).otherwise(
        F.concat(F.lit("depth_"), F.date_format(d, "yyyy_MM_dd"), F.lit(".txt")))
    return v.table("orders").select("o_orderkey", name.alias("file"))


@case("filename_metadata", f"""with f as (select o_orderkey, o_custkey, cast(o_orderdate as date) d from orders)
    select o_orderkey, d as file_date, case when o_orderkey % 3 = 1 and o_custkey % 5 < 4
        then regexp_extract({FILE_NAME}, '^(.+)_SWE_', 1) end as sensor from f""")
def _(v: Views):
    return _files(v).select("o_orderkey", readers.file_date(F.col("file")).alias("file_date"),
                            readers.file_sensor(F.col("file"), SENSOR_PRIORITY).alias("sensor"))


@case("sensor_priority", """with s as (select ord, date, case cast(station_id as bigint) % 5 when 0 then 'DMSP_SMMR'
        when 1 then 'F08_SSMI' when 2 then 'F13_SSMI' when 3 then 'F17_SSMIS' else 'F99_OTHER' end sensor from obs),
    r as (select *, case sensor when 'DMSP_SMMR' then 1 when 'F08_SSMI' then 2 when 'F13_SSMI' then 3
        when 'F17_SSMIS' then 4 end p from s)
    select ord, date, sensor from (select *, min(p) over (partition by date) lo from r where p is not null)
    where p = lo""")
def _(v: Views):
    k = F.col("station_id").cast("bigint") % 5
    sensor = F.when(k == 0, "DMSP_SMMR").when(k == 1, "F08_SSMI").when(k == 2, "F13_SSMI").when(
        k == 3, "F17_SSMIS").otherwise("F99_OTHER")
    return readers.first_sensor(v.obs.select("ord", "date", sensor.alias("sensor")), SENSOR_PRIORITY)


@case("date_spine", """select cast(d as date) as date from (select unnest(generate_series(
    cast((select min(date) from obs) as timestamp), cast((select max(date) from obs) as timestamp),
    interval 1 day)) d)""")
def _(v: Views):
    return readers.date_spine(v.obs.agg(F.min("date").alias("start"), F.max("date").alias("end")))


@case("band_unstack", """select vec_id, cast(date '2015-01-01' + cast(i - 1 as integer) as date) as date,
    cast(i - 1 as bigint) as band, round(cast(embedding[i] as double), 6) as value
    from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) i from embeddings)""")
def _(v: Views):
    stacks = v.table("embeddings").withColumn("first_day", F.lit("2015-01-01").cast("date"))
    out = readers.unstack_bands(stacks, "embedding", "first_day", ["vec_id"])
    return rounded(out.withColumn("value", F.col("value").cast("double")), 6, "value")


@case("ascii_grid_cells", """select vec_id, cast((i - 1) // 8 as bigint) as row_, cast((i - 1) % 8 as bigint) as col_,
    case when i % 10 <> 0 then cast(round(cast(embedding[i] as double) * 1000) as double) end as value,
    60 + 0.25 * ((i - 1) % 8)::double as x, 15 + 0.25 * (7 - (i - 1) // 8)::double as y
    from (select vec_id, embedding, unnest(range(1, 65)) i from embeddings)""")
def _(v: Views):
    e = v.table("embeddings").select("vec_id", F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x, i: F.when((i + 1) % 10 == 0, F.lit("-9999")).otherwise(
            F.round(x * 1000).cast("string"))).alias("c"))
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.array_join(F.slice("c", r * 8 + 1, 8), " "))
    head = ("ncols 8\nnrows 8\nxllcenter 60\nyllcenter 15\ncellsize 0.25\nNODATA_value -9999\n")
    text = e.select("vec_id", F.concat(F.lit(head), F.array_join(lines, "\n")).alias("text"))
    return readers.ascii_grid_cells(text, keep=["vec_id"]).withColumnsRenamed({"row": "row_", "col": "col_"}).withColumn(
        "value", F.col("value") + 0.0)


@case("column_aliases", "select cast(c_custkey as varchar) as station_id, c_acctbal as longitude, c_nationkey::bigint as latitude from customer")
def _(v: Views):
    raw = v.table("customer").select(F.col("c_custkey").cast("string").alias("Station_ID"),
                                     F.col("c_acctbal").alias("Lon"), F.col("c_nationkey").alias("Latitude"))
    return normalize.rename_aliases(raw)


@case("date_normalize", """select o_orderkey, case when o_orderkey % 7 = 3 then null else cast(o_orderdate as date) end
    as date from orders""")
def _(v: Views):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    text = F.col("o_orderpriority")
    for i, form in ((0, "yyyy-MM-dd"), (1, "yyyy/MM/dd"), (2, "yyyy-MM-dd HH:mm:ss"), (4, "yyyy-MM-dd'T'HH:mm:ss"),
                    (5, "yyyy/MM/dd HH:mm:ss"), (6, "yyyyMMdd")):
        text = F.when(k == i, F.date_format(d, form)).otherwise(text)
    return v.table("orders").select("o_orderkey", scalar.parse_date(text).alias("date"))


@case("numeric_date_decode", "select o_orderkey, cast(o_orderdate as date) as date from orders")
def _(v: Views):
    number = F.date_format("o_orderdate", "yyyyMMdd").cast("double")
    return v.table("orders").select("o_orderkey", scalar.decode_numeric_date(number).alias("date"))


@case("year_doy_to_date", """select o_orderkey, case when dd >= 1 and year(make_date(y, 1, 1) + cast(dd - 1 as integer)) = y
    then cast(make_date(y, 1, 1) + cast(dd - 1 as integer) as date) end as date
    from (select o_orderkey, year(o_orderdate) y, o_orderkey % 370 dd from orders)""")
def _(v: Views):
    return v.table("orders").select("o_orderkey", scalar.year_doy_to_date(
        F.year("o_orderdate"), F.col("o_orderkey") % 370).alias("date"))


@case("station_id_canon", """select o_orderkey, case o_orderkey % 7 when 2 then o_orderpriority
    when 3 then o_custkey || 'D' when 4 then o_custkey || 'f' when 5 then o_custkey || 'e3' when 6 then '00' || o_custkey
    else cast(o_custkey as varchar) end as station_id from orders""")
def _(v: Views):
    k, number = F.col("o_orderkey") % 7, F.col("o_custkey").cast("string")
    text = F.when(k == 0, F.col("o_custkey").cast("double").cast("string")).when(
        k == 1, F.concat(F.lit(" "), number, F.lit(" "))).when(k == 3, F.concat(number, F.lit("D"))).when(
        k == 4, F.concat(number, F.lit("f"))).when(k == 5, F.concat(number, F.lit("e3"))).when(
        k == 6, F.concat(F.lit("00"), number, F.lit(".0"))).otherwise(F.col("o_orderpriority"))
    return v.table("orders").select("o_orderkey", scalar.canonical_id(text).alias("station_id"))


@case("bbox_filter", "select station_id, lon, lat from station where lon between 80 and 100.5 and lat between 25 and 40")
def _(v: Views):
    return filters.station_filter(v.station, "bbox:80,25,100.5,40", "lon", "lat").select("station_id", "lon", "lat")


@case("ids_filter", "select station_id, date, swe, ord from obs where station_id in ('1', '17', '399')")
def _(v: Views):
    return filters.station_filter(v.obs, "ids:1, 17,399")


@case("time_range", "select o_orderkey, o_orderdate from orders where o_orderdate between timestamp '1997-03-01' and timestamp '1997-09-30'")
def _(v: Views):
    return filters.time_range(v.table("orders"), "1997-03-01", "1997-09-30", "o_orderdate").select(
        "o_orderkey", "o_orderdate")


@case("coord_coercion", """select station_id, lon as longitude, lat as latitude from station
    where num % 5 not in (3, 4)""")
def _(v: Views):
    k = F.col("num") % 5
    text = v.station.select(
        "station_id", F.when(k == 3, F.lit("n/a")).otherwise(F.col("lon").cast("string")).alias("longitude"),
        F.when(k == 4, F.lit("NaN")).otherwise(F.col("lat").cast("string")).alias("latitude"))
    return normalize.valid_coordinates(text)


@case("valid_range_scale", """select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity, round(l_extendedprice*0.01, 6) as value
    from lineitem where l_extendedprice between 2000 and 90000 and l_quantity <> 50""")
def _(v: Views):
    spec = SourceSpec("depth", fill=-9999.0, valid_min=2000, valid_max=90000, scale=0.01)
    src = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_quantity") == 50, F.lit(-9999.0)).otherwise(F.col("l_extendedprice")).alias("value"))
    return rounded(filters.mask_and_scale(src, spec), 6, "value")


@case("fill_to_null", """select station_id, aspect, slope from terrain where aspect is not null""")
def _(v: Views):
    filled = v.terrain.fillna(-9999.0)
    return filters.fill_to_null(filled, ["aspect", "slope"])


@case("kelvin_celsius", "select station_id, year, month, round(value*0.01 - 273.15, 8) as value from dyn_temp")
def _(v: Views):
    spec = SourceSpec("t", scale=0.01, unit="K")
    return rounded(filters.mask_and_scale(v.dyn_temp, spec), 8, "value")


@case("sentinel_null", "select station_id, date, case when value > 200 then null else round(value, 6) end as cswe from dyn_cswe")
def _(v: Views):
    return v.dyn_cswe.select("station_id", "date", F.round(scalar.null_above(F.col("value")), 6).alias("cswe"))


@case("bad_dates", "select ord, date from obs where date not in (date '2014-03-05', date '2015-10-11')")
def _(v: Views):
    return filters.drop_bad_dates(v.obs, "date", ["2014-03-05", "2015-10-11"]).select("ord", "date")


@case("drop_columns", "select station_id, swe, ord from obs")
def _(v: Views):
    return normalize.drop_time_columns(v.obs.withColumn("landuse_class", F.lit("x")), ["landuse_class"])


@case("feature_columns", """select station_id, altitude, landuse_code from station""")
def _(v: Views):
    df = v.station.withColumns({"landuse_hash_0": F.lit(1.0), "id": F.col("num")})
    keep = feature_columns(df, ("station_id", "date", "swe", "id", "num", "lon", "lat"))
    return df.select("station_id", *keep)


@case("constant_columns", """select 'one' as "column", true as is_constant union all select 'empty', true
    union all select 'l_tax', false union all select 'l_returnflag', false""")
def _(v: Views):
    df = v.table("lineitem").select("l_tax", "l_returnflag", F.lit(1).alias("one"),
                                    F.lit(None).cast("double").alias("empty"))
    return filters.column_variety(df, df.columns)


@case("terrain_features", """select station_id, round(cos(radians(aspect)), 9) as northness,
    round(sin(radians(aspect)), 9) as eastness, altitude*slope as elevation_slope
    from station join terrain using (station_id)""")
def _(v: Views):
    df = v.station.join(v.terrain, "station_id")
    out = physical_features(df, elevation="altitude", date=None)
    return rounded(out.select("station_id", "northness", "eastness", "elevation_slope"), 9, "northness", "eastness")


@case("target_log", "select ord, round(ln(1 + swe), 9) as swe_log, round(exp(ln(1 + swe)) - 1, 6) as swe_back from obs")
def _(v: Views):
    return v.obs.select("ord", F.round(F.log1p("swe"), 9).alias("swe_log"),
                        F.round(F.expm1(F.log1p("swe")), 6).alias("swe_back"))


@case("composite_key", "select num, cast(num as varchar) || '_' || cast(landuse_code as varchar) as site from station")
def _(v: Views):
    return v.station.select("num", normalize.composite_key("num", "landuse_code").alias("site"))


@case("row_ids", "select l_partkey, cast(q as double) as q, row_number() over (order by l_partkey) - 1 as id from (select l_partkey, sum(l_quantity) q from lineitem group by 1)")
def _(v: Views):
    return normalize.row_ids(v.table("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")), "l_partkey")


@case("category_codes", """with z as (select num, case when num % 7 = 0 then null else zone end as zone from station)
    select num, zone, cast(dense_rank() over (order by zone nulls last) - 1 as bigint) as code from z""")
def _(v: Views):
    df = v.station.select("num", F.when(F.col("num") % 7 != 0, F.col("zone")).alias("zone"))
    return normalize.category_codes(df, "zone", "code")


@case("class_labels", """select num, landuse_code + num % 3 as code,
    coalesce(c.label, 'Class_' || cast(landuse_code + num % 3 as varchar)) as label
    from station left join classes c on c.code = landuse_code + num % 3""")
def _(v: Views):
    df = v.station.select("num", (F.col("landuse_code") + F.col("num") % 3).alias("code"))
    return normalize.class_labels(df, v.classes, "code", "label")


@case("validation_report", """select count(*) as rows, count(distinct station_id) as stations,
    cast(sum(case when swe is not null then 1 else 0 end) as bigint) as complete_rows, 'elevation' as missing_columns,
    false as valid from obs""")
def _(v: Views):
    return filters.validation_report(v.obs, ["station_id", "date", "swe", "elevation"])


@case("default_columns", "select ord, cast(year(date) as double) as year, cast(dayofyear(date) as double) as doy, cast(0 as double) as tpi from obs")
def _(v: Views):
    return default_columns(v.obs, ["year", "doy", "tpi", "swe"]).select("ord", "year", "doy", "tpi")


@case("full_distinct", "select distinct l_returnflag, l_linestatus, l_quantity, l_tax from lineitem")
def _(v: Views):
    return normalize.distinct_rows(v.table("lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_tax"))


@case("removed_duplicates", """select (select count(*) from lineitem) as rows_before, count(*) as rows_after,
    (select count(*) from lineitem) - count(*) as removed from (select distinct l_orderkey, l_linenumber from lineitem)""")
def _(v: Views):
    return normalize.removed_duplicates(v.table("lineitem").select("l_orderkey", "l_linenumber"))


@case("haversine", """select num, round(2*6371.0*asin(least(1.0, sqrt(power(sin(radians(39.9 - lat)/2), 2) +
    cos(radians(lat))*cos(radians(39.9))*power(sin(radians(116.4 - lon)/2), 2)))), 6) as km from station""")
def _(v: Views):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(39.9), F.lit(116.4))
    return v.station.select("num", F.round(km, 6).alias("km"))


@case("laea_project", """select num, round(2*6371228.0*sin(radians(90 - lat)/2)*sin(radians(lon)), 3) as x,
    round(-2*6371228.0*sin(radians(90 - lat)/2)*cos(radians(lon)), 3) as y from station""")
def _(v: Views):
    x, y = geo.laea(F.col("lat"), F.col("lon"))
    return v.station.select("num", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@case("albers_project", """with c as (select (sin(radians(25.0)) + sin(radians(47.0)))/2 as n),
    k as (select n, power(cos(radians(25.0)), 2) + 2*n*sin(radians(25.0)) as cc from c),
    p as (select num, n, 6371000.0*sqrt(cc - 2*n*sin(radians(lat)))/n as rho, n*radians(lon - 105) as th,
        6371000.0*sqrt(cc)/n as rho0 from station, k)
    select num, round(rho*sin(th), 3) as x, round(rho0 - rho*cos(th), 3) as y from p""")
def _(v: Views):
    x, y = geo.albers(F.col("lat"), F.col("lon"), 25.0, 47.0, 0.0, 105.0, 6371000.0, None)
    return v.station.select("num", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@case("calendar_parts", """select ord, year(date) as year, month(date) as month, day(date) as day,
    dayofyear(date) as doy, strftime(date, '%Y-%m') as year_month, strftime(date, '%B') as month_name from obs""")
def _(v: Views):
    from stationloom.functions.calendar import calendar_parts

    return calendar_parts(v.obs).drop("station_id", "date", "swe")


@case("guarded_percent", """select station_id, case when v > 0 then 100.0::double*s/v end as pct from (select station_id, count(*)
    filter (swe > 250) s, count(swe) v from obs group by 1)""")
def _(v: Views):
    per = v.obs.groupBy("station_id").agg(F.count_if(F.col("swe") > 250).alias("s"), F.count("swe").alias("v"))
    return per.select("station_id", scalar.guarded_percent(F.col("s"), F.col("v")).alias("pct"))


@case("gaussian_weight", "select num, round(exp(-0.5*power(abs(lon - 100)/5.0, 2)), 12) as w from station")
def _(v: Views):
    return v.station.select("num", F.round(scalar.gaussian_weight(F.abs(F.col("lon") - 100), 5.0), 12).alias("w"))


@case("tile_grid", """with b as (select min(lon) w, max(lon) e, min(lat) s, max(lat) n from station),
    i as (select unnest(range(0, (select cast(floor((e - w)/5) as bigint) + 1 from b))) tile_x),
    j as (select unnest(range(0, (select cast(floor((n - s)/5) as bigint) + 1 from b))) tile_y)
    select tile_x, tile_y, round(w + tile_x*5, 6) as lon_min, round(least(w + (tile_x + 1)*5, e), 6) as lon_max,
    round(s + tile_y*5, 6) as lat_min, round(least(s + (tile_y + 1)*5, n), 6) as lat_max from b, i, j
    where w + tile_x*5 < least(w + (tile_x + 1)*5, e) and s + tile_y*5 < least(s + (tile_y + 1)*5, n)""")
def _(v: Views):
    bounds = v.station.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"),
                           F.max("lat").alias("north"))
    return rounded(geo.tile_grid(bounds), 6, "lon_min", "lon_max", "lat_min", "lat_max")


@case("tile_counts", """with b as (select min(lon) w, min(lat) s from station)
    select cast(floor((lon - w)/5) as bigint) as tile_x, cast(floor((lat - s)/5) as bigint) as tile_y, count(*) as stations
    from station, b group by 1, 2""")
def _(v: Views):
    from stationloom.operators.ranking import one_row

    west = one_row(v.station.agg(F.min("lon").alias("w"), F.min("lat").alias("s")))
    keyed = v.station.select(
        F.floor((F.col("lon") - west.getField("w")) / 5).alias("tile_x"),
        F.floor((F.col("lat") - west.getField("s")) / 5).alias("tile_y"))
    return keyed.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("stations"))
