"""Sampling of gridded products at points."""

from pyspark.sql import functions as F

from checks.base import GRID, Views, case, rounded
from stationloom.functions import geo
from stationloom.operators import sampling
from stationloom.operators.quality import fill_rates
from stationloom.plans import fusion
from stationloom.sources.spec import GridSpec, SourceSpec

AT = "cast(floor((53 - lat)/0.9) as bigint) as row_, cast(floor((lon - 73)/1.25) as bigint) as col_"


def _points(v: Views):
    return v.station.select("station_id", "lon", "lat")


def _named(df):
    return df.withColumnsRenamed({"row": "row_", "col": "col_"})


def _centres(v: Views):
    return v.cells.select("cell_id", (73.625 + 1.25 * F.col("col")).alias("lon"), (52.55 - 0.9 * F.col("row")).alias("lat"))


@case("grid_affine_sample", f"""with p as (select station_id, {AT} from station)
    select p.station_id, p.row_, p.col_, c.layer, c.value from p join cells c on c.row_ = p.row_ and c.col_ = p.col_""")
def _(v: Views):
    out = sampling.sample_affine(_points(v), v.cells.drop("cell_id"), GRID, (), "lon", "lat")
    return _named(out.drop("lon", "lat"))


@case("grid_dated_sample", f"""with p as (select o.ord, make_date(2014, month(o.date), 1) as date, {AT} from obs o join station s using (station_id)),
    g as (select make_date(2014, 1 + (row_ + col_) % 12, 1) as date, row_, col_, max(value) as value from cells group by 1, 2, 3)
    select p.ord, p.date, g.value from p join g on g.date = p.date and g.row_ = p.row_ and g.col_ = p.col_""")
def _(v: Views):
    month = F.make_date(F.lit(2014), 1 + (F.col("row") + F.col("col")) % 12, F.lit(1))
    cells = v.cells.groupBy(month.alias("date"), "row", "col").agg(F.max("value").alias("value"))
    points = v.obs.withColumn("date", F.make_date(F.lit(2014), F.month("date"), F.lit(1))).join(_points(v), "station_id")
    return sampling.sample_affine(points, cells, GRID, ("date",), "lon", "lat").select("ord", "date", "value")


@case("grid_axis_nearest", """with p as (select station_id, 2*6371228.0*sin(radians(90 - lat)/2)*sin(radians(lon)) as x,
        -2*6371228.0*sin(radians(90 - lat)/2)*cos(radians(lon)) as y from station),
    q as (select station_id, least(greatest(cast(floor(x/150000.0 + 0.5) as bigint), 0), 49) as col_,
        least(greatest(cast(floor((6000000.0 - y)/200000.0 + 0.5) as bigint), 0), 39) as row_ from p)
    select q.station_id, q.row_, q.col_, c.layer, c.value from q join cells c on c.row_ = q.row_ and c.col_ = q.col_""")
def _(v: Views):
    x, y = geo.laea(F.col("lat"), F.col("lon"))
    points = _points(v).select("station_id", x.alias("x"), y.alias("y"))
    grid = GridSpec(0.0, 6000000.0, 150000.0, 200000.0, 40, 50, "centre")
    return _named(sampling.sample_axis(points, v.cells.drop("cell_id"), grid, ()).drop("x", "y"))


@case("grid_nearest_capped", """with c as (select cell_id, 73.625::double + 1.25::double*col_ as lon, 52.55::double - 0.9::double*row_ as lat from cells),
    r as (select s.station_id, s.lon, s.lat, c.cell_id, c.lon as clon, c.lat as clat, row_number() over (partition by s.station_id
        order by sqrt((s.lon - c.lon)*(s.lon - c.lon) + (s.lat - c.lat)*(s.lat - c.lat)), c.cell_id) rn from station s, c),
    d as (select *, 2*6371.0*asin(least(1.0, sqrt(power(sin(radians(clat - lat)/2), 2) +
        cos(radians(lat))*cos(radians(clat))*power(sin(radians(clon - lon)/2), 2)))) as km from r where rn = 1)
    select station_id, cell_id, round(clon, 6) as matched_lon, round(clat, 6) as matched_lat, round(km, 6) as distance_km from d where km < 50""")
def _(v: Views):
    found = sampling.nearest_cells(_points(v), _centres(v), 50.0, "lon", "lat")
    out = _points(v).join(found, ["lon", "lat"]).drop("lon", "lat")
    return rounded(out, 6, "matched_lon", "matched_lat", "distance_km")


@case("grid_nearest_values", """with c as (select min(cell_id) as cell_id, 73.625::double + 1.25::double*col_ as lon, 52.55::double - 0.9::double*row_ as lat from cells group by 2, 3),
    r as (select s.station_id, s.lon, s.lat, c.cell_id, c.lon as clon, c.lat as clat, row_number() over (partition by s.station_id
        order by sqrt((s.lon - c.lon)*(s.lon - c.lon) + (s.lat - c.lat)*(s.lat - c.lat)), c.cell_id) rn from station s, c),
    d as (select * from r where rn = 1 and 2*6371.0*asin(least(1.0, sqrt(power(sin(radians(clat - lat)/2), 2) +
        cos(radians(lat))*cos(radians(clat))*power(sin(radians(clon - lon)/2), 2)))) < 30)
    select o.ord, l.l_quantity, l.l_extendedprice from obs o join d on d.station_id = o.station_id
    join lineitem l on l.l_partkey = d.cell_id and cast(cast(l.l_shipdate as date) + interval 16 year as date) = o.date""")
def _(v: Views):
    # line items stand in for dated cell values: part is the cell, shipping day the date
    values = v.table("lineitem").select(F.col("l_partkey").alias("cell_id"), F.add_months(F.col("l_shipdate").cast("date"), 192).alias("date"),
                                        "l_quantity", "l_extendedprice")
    points = v.obs.join(_points(v), "station_id")
    return sampling.sample_nearest(points, _centres(v), values, 30.0, ("date",), "lon", "lat").select("ord", "l_quantity", "l_extendedprice")


@case("grid_monthly", f"""with p as (select o.ord, year(o.date) as year, month(o.date) as month, {AT} from obs o join station s using (station_id)),
    g as (select 2011 + layer % 7 + row_ % 3 as year, 1 + col_ % 12 as month, row_, col_, max(value) as value from cells group by 1, 2, 3, 4)
    select p.ord, round(g.value*0.01 - 273.15, 8) as value from p join g on g.year = p.year and g.month = p.month and g.row_ = p.row_ and g.col_ = p.col_
    where g.value is not null""")
def _(v: Views):
    cells = v.cells.select((2011 + F.col("layer") % 7 + F.col("row") % 3).alias("year"), (1 + F.col("col") % 12).alias("month"),
                           "row", "col", "value").groupBy("year", "month", "row", "col").agg(F.max("value").alias("value"))
    spec = SourceSpec("temperature", scale=0.01, unit="K", grid=GRID, every="month")
    points = v.obs.join(_points(v), "station_id")
    return rounded(fusion.sample_source(spec, points, cells, lon="lon", lat="lat").select("ord", "value"), 8, "value")


@case("grid_yearly", f"""with y as (select station_id, {AT}, unnest([2013, 2014, 2015]) as year from station),
    g as (select 2013 + layer % 3 as year, row_, col_, max(value) as value from cells group by 1, 2, 3)
    select y.station_id, cast(y.year as bigint) as year, g.value from y join g on g.year = y.year and g.row_ = y.row_ and g.col_ = y.col_""")
def _(v: Views):
    cells = v.cells.groupBy((2013 + F.col("layer") % 3).alias("year"), "row", "col").agg(F.max("value").alias("value"))
    out = sampling.sample_yearly(_points(v), [2013, 2014, 2015], cells, GRID, "lon", "lat")
    return out.select("station_id", "year", "value")


@case("grid_coverage", """with p as (select lon, lat, floor((40 - lat)/0.9) r, floor((lon - 80)/1.25) c from station)
    select count(*) as points, count(*) filter (r between 0 and 19 and c between 0 and 29) as in_bounds,
    count(*) filter (not (r between 0 and 19 and c between 0 and 29)) as out_of_bounds, min(lon) as min_lon, max(lon) as max_lon,
    min(lat) as min_lat, max(lat) as max_lat, count(*) filter (lon < 0 or lat < 0) as negative_coordinates from p""")
def _(v: Views):
    return sampling.coverage_report(_points(v), GridSpec(80.0, 40.0, 1.25, 0.9, 20, 30), "lon", "lat")


@case("grid_sample_fill", f"""with p as (select station_id, {AT} from station)
    select 'value' as "column", count(c.value) as filled, count(*) as records, round(100.0::double*count(c.value)/count(*), 6) as fill_pct
    from p join cells c on c.row_ = p.row_ and c.col_ = p.col_""")
def _(v: Views):
    out = sampling.sample_affine(_points(v), v.cells, GRID, (), "lon", "lat")
    return rounded(fill_rates(out, ["value"]), 6, "fill_pct")
