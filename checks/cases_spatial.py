"""Neighbours, autocorrelation, weighted regression, distances and clusters."""

from pyspark.sql import functions as F

from checks.base import Views, case, rounded
from stationloom.operators import spatial, ward

KNN = """with e as (select * from (select a.num as id, b.num as neighbor, a.altitude as za, b.altitude as zb,
    sqrt((a.lon - b.lon)*(a.lon - b.lon) + (a.lat - b.lat)*(a.lat - b.lat)) as d,
    row_number() over (partition by a.num order by sqrt((a.lon - b.lon)*(a.lon - b.lon) + (a.lat - b.lat)*(a.lat - b.lat)), b.num) as rank
    from station a join station b on a.num <> b.num) where rank <= 8)"""


def _points(v: Views):
    return v.station.select(F.col("num").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"), "altitude")


@case("knn", f"{KNN} select id, neighbor, round(d, 9) as distance, rank from e")
def _(v: Views):
    out = spatial.knn(_points(v).drop("altitude"), 8).select("id", "neighbor", "distance", "rank")
    return rounded(out, 9, "distance")


@case("morans_i", f"""{KNN}, m as (select avg(altitude) mu, count(*)::double n from station), s as (select sum((altitude - mu)*(altitude - mu)) zz from station, m),
    c as (select sum((za - mu)*(zb - mu))/8 as cross_sum from e, m), mu2 as (select count(*)::double as mutual from e a join e b on a.id = b.neighbor and a.neighbor = b.id),
    dg as (select sum(c*c)::double as deg2 from (select count(*) c from e group by neighbor)),
    t as (select n, cross_sum/zz as i, -1/(n - 1) as ei, n/8 + mutual/64 as s1, 3*n + deg2/64 as s2 from m, s, c, mu2, dg),
    w as (select n, i, ei, (n*n*s1 - n*s2 + 3*n*n)/((n*n - 1)*n*n) - ei*ei as vi from t)
    select n, round(i, 9) as i, round(ei, 9) as ei, round(vi, 9) as vi, round((i - ei)/sqrt(vi), 6) as z from w""")
def _(v: Views):
    return rounded(rounded(spatial.morans_i(_points(v), "altitude", 8), 9, "i", "ei", "vi"), 6, "z")


@case("local_r2", """with s as (select var_pop(altitude)*count(*) t from station)
    select num, round(1 - power(altitude - 100.0::double*landuse_code, 2)/t, 9) as local_r2 from station, s""")
def _(v: Views):
    out = spatial.local_r2(v.station.select("num", "altitude", "landuse_code"), "altitude", F.lit(100.0).cast("double") * F.col("landuse_code"))
    return rounded(out.select("num", "local_r2"), 9, "local_r2")


@case("linearity_verdict", """with s as (select var_pop(altitude)*count(*) t from station), l as (select 1 - power(altitude - 100.0::double*landuse_code, 2)/t as r from station, s)
    select round(avg(r), 9) as mean, round(stddev_pop(r), 9) as std, round(min(r), 9) as min, round(max(r), 9) as max, round(stddev_pop(r)/avg(r), 9) as cv,
    case when stddev_pop(r)/avg(r) > 0.3 then 'nonlinear' else 'linear' end as verdict from l""")
def _(v: Views):
    rows = spatial.local_r2(v.station, "altitude", F.lit(100.0).cast("double") * F.col("landuse_code"))
    out = spatial.local_r2_summary(rows).withColumn(
        "verdict", spatial.linearity_verdict(F.lit(0.5), F.col("cv"), F.lit(0.7), F.lit(0.7)))
    return rounded(out, 9, "mean", "std", "min", "max", "cv")


GWR = """with q as (select distinct lon, lat from station), p as (select q.lon, q.lat, exp(-0.5*((q.lon - s.lon)*(q.lon - s.lon) + (q.lat - s.lat)*(q.lat - s.lat))/(1.5*1.5)) as w,
    cast(s.landuse_code as double) as f, s.altitude as y from q, station s),
    g as (select lon, lat, max(w) as w_max, sum(w) as s_0_0, sum(w*f) as s_0_1, sum(w*f*f) as s_1_1, sum(w*y) as s_0_y, sum(w*f*y) as s_1_y from p group by 1, 2)"""


@case("gwr_normal_sums", f"""{GWR} select lon, lat, round(w_max, 6) as w_max, round(s_0_0, 6) as s_0_0, round(s_0_1, 5) as s_0_1, round(s_1_1, 4) as s_1_1,
    round(s_0_y, 3) as s_0_y, round(s_1_y, 2) as s_1_y from g""")
def _(v: Views):
    out = spatial.gwr_sums(v.station, v.station, ["landuse_code"], "altitude", 1.5, "lon", "lat")
    for digits, c in ((6, "w_max"), (6, "s_0_0"), (5, "s_0_1"), (4, "s_1_1"), (3, "s_0_y"), (2, "s_1_y")):
        out = rounded(out, digits, c)
    return out


@case("gwr_predict", f"""{GWR}, b as (select lon, lat, (s_1_1*s_0_y - s_0_1*s_1_y)/(s_0_0*s_1_1 - s_0_1*s_0_1) as b0, (s_0_0*s_1_y - s_0_1*s_0_y)/(s_0_0*s_1_1 - s_0_1*s_0_1) as b1 from g)
    select s.num, round(b0 + b1*s.landuse_code, 3) as gwr_pred from station s join b on b.lon = s.lon and b.lat = s.lat""")
def _(v: Views):
    out = spatial.gwr_predict(v.station, v.station, ["landuse_code"], "altitude", 1.5, "lon", "lat")
    return rounded(out.select("num", "gwr_pred"), 3, "gwr_pred")


REFS = "(select landuse_code as id, avg(lon) as x, avg(lat) as y, cast(min(num) as double) as t from station group by 1)"


def _refs(v: Views):
    return v.station.groupBy(F.col("landuse_code").alias("id")).agg(
        F.avg("lon").alias("x"), F.avg("lat").alias("y"), F.min("num").cast("double").alias("t"))


def _timed(v: Views):
    return v.station.select(F.col("num").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"),
                            F.col("altitude").alias("t"))


NEAR_REFS = f"""(select *, row_number() over (partition by id order by space, ref) as rn from (select s.num as id, r.id as ref,
    sqrt((s.lon - r.x)*(s.lon - r.x) + (s.lat - r.y)*(s.lat - r.y)) as space, abs(s.altitude - r.t) as time from station s, {REFS} r))"""


@case("pair_distances", f"select id, ref, round(space, 6) as space, round(time, 6) as time from {NEAR_REFS} where rn <= 8")
def _(v: Views):
    return rounded(spatial.pair_distances(_timed(v), _refs(v), 8), 6, "space", "time")


@case("pair_distance_stats", f"""select count(*) as pairs, round(min(d), 6) as min, round(max(d), 6) as max, round(avg(d), 6) as mean,
    round(stddev_pop(d), 6) as std, round(avg(case when d < 1e-6 then 1.0::double else 0 end), 9) as zero_share, 0.0::double as mean_error
    from (select sqrt((s.lon - r.lon)*(s.lon - r.lon) + (s.lat - r.lat)*(s.lat - r.lat)) as d from station s, station r)""")
def _(v: Views):
    places = v.station.select(F.col("lon").alias("x"), F.col("lat").alias("y"))
    return rounded(rounded(spatial.pair_distance_stats(places, places), 6, "min", "max", "mean", "std"), 9, "zero_share")


@case("pair_time_stats", f"""select count(*) as pairs, round(min(d), 6) as min, round(max(d), 6) as max, round(avg(d), 6) as mean,
    round(stddev_pop(d), 6) as std, round(avg(case when d < 1e-6 then 1.0::double else 0 end), 9) as zero_share
    from (select abs(s.altitude - r.t) as d from station s, {REFS} r)""")
def _(v: Views):
    out = spatial.pair_distance_stats(_timed(v), _refs(v), ["t"]).drop("mean_error")
    return rounded(rounded(out, 6, "min", "max", "mean", "std"), 9, "zero_share")


@case("feature_distance", f"""with c as (select var_samp(lon) a, covar_samp(lon, lat) b, var_samp(lat) d from station),
    p as (select s.num as id, r.id as ref, s.lon - r.x as u, s.lat - r.y as w from station s, {REFS} r)
    select id, ref, round(sqrt((d*u*u - 2*b*u*w + a*w*w)/(a*d - b*b)), 6) as distance from p, c""")
def _(v: Views):
    return rounded(spatial.mahalanobis(_timed(v), _refs(v), ["x", "y"], None), 6, "distance")


@case("feature_neighbours", """with f as (select num, lon, lat, altitude from station),
    c as (select var_samp(lon) aa, covar_samp(lon, lat) ab, covar_samp(lon, altitude) ac, var_samp(lat) bb, covar_samp(lat, altitude) bc,
        var_samp(altitude) cc from f),
    d as (select *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) as det from c),
    p as (select s.num as id, r.num as ref, s.lon - r.lon as u, s.lat - r.lat as v, s.altitude - r.altitude as w from f s, f r),
    e as (select id, ref, sqrt(((bb*cc - bc*bc)*u*u + (aa*cc - ac*ac)*v*v + (aa*bb - ab*ab)*w*w + 2*(ac*bc - ab*cc)*u*v
        + 2*(ab*bc - ac*bb)*u*w + 2*(ab*ac - aa*bc)*v*w)/det) as distance from p, d)
    select id, ref, round(distance, 6) as distance from e qualify row_number() over (partition by id order by distance, ref) <= 5""")
def _(v: Views):
    rows = v.station.select(F.col("num").alias("id"), "lon", "lat", "altitude")
    return rounded(spatial.mahalanobis(rows, rows, ["lon", "lat", "altitude"], 5), 6, "distance")


DBSCAN = """with recursive m as (select avg(lon) a1, stddev_pop(lon) s1, avg(lat) a2, stddev_pop(lat) s2, avg(altitude) a3, stddev_pop(altitude) s3 from station),
    p as (select num as id, (lon - a1)/s1 as f1, (lat - a2)/s2 as f2, (altitude - a3)/s3 as f3 from station, m),
    near as (select a.id as a, b.id as b from p a join p b on (a.f1 - b.f1)*(a.f1 - b.f1) + (a.f2 - b.f2)*(a.f2 - b.f2) + (a.f3 - b.f3)*(a.f3 - b.f3) <= 0.12*0.12),
    core as (select a as id from near group by a having count(*) >= 4),
    link as (select a, b from near where a in (select id from core) and b in (select id from core)),
    reach as (select id as root, id as node from core union select r.root, l.b from reach r join link l on l.a = r.node),
    label as (select node as id, min(root) as label from reach group by 1),
    edge as (select n.a as id, min(l.label) as label from near n join label l on l.id = n.b where n.a not in (select id from core) group by 1),
    named as (select id, dense_rank() over (order by label) - 1 as cluster from (select * from label union all select * from edge))
    select p.id as num, coalesce(n.cluster, (select coalesce(max(cluster) + 1, 0) from named)) as cluster from p left join named n on n.id = p.id"""


@case("station_dbscan", DBSCAN)
def _(v: Views):
    return spatial.dbscan(v.station.select("num", "lon", "lat", "altitude"), ["lon", "lat", "altitude"], 0.12, 4, "num")


@case("coef_clusters", """select station_id, dense_rank() over (order by first) - 1 as cluster
    from (select station_id, min(station_id) over (partition by landuse_code % 4) as first from station)""")
def _(v: Views):
    # four bands of stations, each a spread-out line: wider along itself than the bands are apart from one another
    band = (F.col("landuse_code") % 4).cast("double")
    means = v.station.select("station_id", (band * 40 + F.col("num") % 7).alias("coef_a"),
                             (band * band * 30 + F.col("num") % 11).alias("coef_b"))
    return ward.ward_clusters(means, ["coef_a", "coef_b"], 4, "station_id")


@case("ward_costs", """select count(distinct lon || ',' || lat) - 1 as merges, round(count(*)*(var_pop(lon) + var_pop(lat)), 4) as total from station""")
def _(v: Views):
    # all merges together cost the squared error around the common mean
    places = v.station.groupBy(F.array("lon", "lat").alias("_w")).agg(F.min("num").alias("node"), F.count(F.lit(1)).alias("_n"))
    tree = ward.merges(places, 2)
    return rounded(tree.agg(F.count(F.lit(1)).alias("merges"), F.sum("height").alias("total")), 4, "total")
