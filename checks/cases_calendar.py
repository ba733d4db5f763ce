"""Hydrological calendar."""

from pyspark.sql import functions as F

from checks.base import Views, case, rounded
from stationloom.functions import calendar as cal

# Equinox and solstice dates by starting year of the season.
EVENTS = """(values (2012, date '2012-09-22', date '2012-12-21', date '2013-03-20', date '2013-06-21'),
    (2013, date '2013-09-22', date '2013-12-21', date '2014-03-20', date '2014-06-21'),
    (2014, date '2014-09-23', date '2014-12-21', date '2015-03-20', date '2015-06-21'),
    (2015, date '2015-09-23', date '2015-12-22', date '2016-03-20', date '2016-06-20'),
    (2016, date '2016-09-22', date '2016-12-21', date '2017-03-20', date '2017-06-21'),
    (2017, date '2017-09-22', date '2017-12-21', date '2018-03-20', date '2018-06-21'),
    (2018, date '2018-09-23', date '2018-12-21', date '2019-03-20', date '2019-06-21')) e(y, au, wi, sp, su)"""


def hy(d: str) -> str:
    return f"(year({d}) + case when month({d}) >= 9 then 1 else 0 end)"


def hd(d: str) -> str:
    return (f"least(366, greatest(1, case when month({d}) >= 9 then dayofyear({d}) - case when "
            f"dayofyear(make_date(year({d}), 12, 31)) = 366 then 244 else 243 end else dayofyear({d}) + 122 end))")


def fixed(d: str) -> str:
    return (f"least(366, greatest(1, case when month({d}) >= 9 then dayofyear({d}) - 243 "
            f"else dayofyear({d}) + 122 end))")


def nearest(shift: int) -> str:
    names = [("au", "autumn_equinox"), ("wi", "winter_solstice"), ("sp", "spring_equinox"), ("su", "summer_solstice")]
    dist = ", ".join(f"case when e.y is not null then abs(hydrological_doy - {hd(c)}) end as distance_to_{n}"
                     for c, n in names)
    least = "least(" + ", ".join(f"distance_to_{n}" for _, n in names) + ")"
    pick = " ".join(f"when distance_to_{n} = {least} then '{n}'" for _, n in names)
    return f"""with h as (select ord, date, {hy('date')} as hydrological_year, {hd('date')} as hydrological_doy from obs),
    j as (select h.*, {dist} from h left join {EVENTS} on e.y + {shift} = hydrological_year)
    select *, case when distance_to_autumn_equinox is not null then {least} end
        as distance_to_nearest_solstice_equinox,
        case {pick} end as nearest_solstice_equinox from j"""


@case("hydro_year", f"select ord, {hy('date')} as end_label, year(date) - case when month(date) < 9 then 1 else 0 end as start_label from obs")
def _(v: Views):
    d = F.col("date")
    return v.obs.select("ord", cal.hydro_year(d).alias("end_label"), cal.hydro_year(d, "start").alias("start_label"))


@case("hydro_doy_fixed", f"select ord, {fixed('date')} as doy from obs")
def _(v: Views):
    return v.obs.select("ord", cal.hydro_doy_fixed(F.col("date")).alias("doy"))


@case("hydro_doy_leap", """select ord, datediff('day', make_date(case when month(date) >= 9 then year(date)
    else year(date) - 1 end, 9, 1), date) + 1 as doy, dayofyear(make_date(year(date), 12, 31)) = 366 as leap from obs""")
def _(v: Views):
    return v.obs.select("ord", cal.hydro_doy(F.col("date")).alias("doy"),
                        cal.is_leap(F.year("date")).alias("leap"))


@case("hydro_doy_natural", """select ord, least(366, greatest(1, case when dayofyear(date) >= 245
    then dayofyear(date) - 244 else dayofyear(date) + 121 end)) as doy from obs""")
def _(v: Views):
    return v.obs.select("ord", cal.hydro_doy_from_natural(F.dayofyear("date")).alias("doy"))


@case("hydro_doy_in_season", """with d as (select ord, datediff('day', make_date(2013, 9, 1), date) + 1 as n from obs)
    select ord, case when n < 1 then n + 365 when n > 366 then n - 365 else n end as doy from d""")
def _(v: Views):
    return v.obs.select("ord", cal.hydro_doy_in_season(F.col("date"), F.lit(2014)).alias("doy"))


@case("event_distance", nearest(1))
def _(v: Views):
    return cal.with_event_distances(v.obs.select("ord", "date"))


@case("event_distance_parity", nearest(0))
def _(v: Views):
    return cal.with_event_distances(v.obs.select("ord", "date"), parity=True)


@case("nearest_event", f"""with n as ({nearest(1)}) select nearest_solstice_equinox, count(*) as records,
    min(distance_to_nearest_solstice_equinox) as lo, max(distance_to_nearest_solstice_equinox) as hi from n group by 1""")
def _(v: Views):
    near = cal.with_event_distances(v.obs.select("ord", "date"))
    d = "distance_to_nearest_solstice_equinox"
    return near.groupBy("nearest_solstice_equinox").agg(
        F.count(F.lit(1)).alias("records"), F.min(d).alias("lo"), F.max(d).alias("hi"))


def _inverse(shift: int, last: int) -> str:
    day = "datediff('day', make_date(cast(hy as integer) - 1, 9, 1), {c}) + 1"
    wrap = "case when {d} < 1 then {d} + 365 when {d} > 366 then {d} - 365 else {d} end"
    cols = []
    for c, n in (("au", "autumn_equinox"), ("wi", "winter_solstice"), ("sp", "spring_equinox"),
                 ("su", "summer_solstice")):
        e = "(" + wrap.format(d="(" + day.format(c=c) + ")") + ")"
        dist = f"least(abs(doy - {e}), abs(doy - {e} - 365), abs(doy - {e} + 365))"
        cols.append(f"case when {e} is null then null when {dist} = 0 then 1.0::double else round(1/cast({dist} as double), 9) end "
                    f"as inverse_dist_{n}")
    return f"""with h as (select ord, {hy('date')} as hy, {hd('date')} as doy from obs)
    select ord, {', '.join(cols)} from h left join {EVENTS} on e.y + {shift} = hy and e.y <= {last}"""


@case("inverse_event_distance", _inverse(1, 2018))
def _(v: Views):
    base = v.obs.select("ord", cal.hydro_year(F.col("date")).alias("hydrological_year"),
                        cal.hydro_doy(F.col("date")).alias("hydrological_doy"))
    out = cal.with_inverse_event_distances(base).drop("hydrological_year", "hydrological_doy")
    return rounded(out, 9, *[c for c in out.columns if c != "ord"])


@case("inverse_event_distance_parity", _inverse(0, 2017))
def _(v: Views):
    base = v.obs.select("ord", cal.hydro_year(F.col("date")).alias("hydrological_year"),
                        cal.hydro_doy(F.col("date")).alias("hydrological_doy"))
    out = cal.with_inverse_event_distances(base, parity=True).drop("hydrological_year", "hydrological_doy")
    return rounded(out, 9, *[c for c in out.columns if c != "ord"])


@case("phenology_date", """with p as (select event_id, cast(1 + floor(value) % 366 as integer) as n, date from phen)
    select event_id, cast(make_date(2023, 9, 1) + (n - 1) as date) as snow_date,
    abs(datediff('day', date, make_date(2023, 9, 1) + (n - 1))) > 30 as far from p""")
def _(v: Views):
    n = (1 + F.floor("value") % 366).cast("int")
    snow = cal.phenology_date(F.lit(2023), n)
    return v.phen.select("event_id", snow.alias("snow_date"), cal.far_from_target(snow, F.col("date")).alias("far"))
