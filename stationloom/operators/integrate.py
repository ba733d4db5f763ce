"""Master index, wide table and the enrichment joins around it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom.operators.normalize import keep_first
from stationloom.operators.ranking import one_row
from stationloom.sources.spec import SourceSpec

KEYS = ("station_id", "date")


@dataclass(frozen=True)
class Part:
    """One frame that feeds a keyed merge: ``{output: input}`` values and the order that picks a row."""

    df: DataFrame
    values: Mapping[str, str] = field(default_factory=dict)
    order: str | None = None
    index: bool = True       # whether its keys enter the result


def value_names(spec: SourceSpec) -> dict[str, str]:
    """Output column per value column: the source name, or ``<source>_<column>`` for several."""
    if len(spec.values) == 1:
        return {spec.name: spec.values[0]}
    return {f"{spec.name}_{v}": v for v in spec.values}


def merge_parts(parts: Sequence[Part], keys: Sequence[str] = KEYS) -> DataFrame:
    """Outer merge of any number of frames on one key, first row per key and frame.

    The frames are stacked and aggregated once. That one exchange replaces a distinct for the index, a
    dedup window and a join per source; copies of a key are reduced before it, so hot keys cost nothing.
    """
    stacked, aggregates, picks = [], {}, {}
    for i, part in enumerate(parts):
        columns = [*keys, F.lit(1 if part.index else 0).alias("_index")]
        row, order = f"_v{i}", f"_o{i}"
        if part.values:
            values = [F.col(source) for source in part.values.values()]
            # one whole row per key: the order column decides, then known values before missing ones
            ties = [x for v in values for x in (v.isNull(), v)]
            if part.order:      # a row without an order comes after those that have one, and is not lost
                ties = [F.col(part.order).isNull(), F.col(part.order), *ties]
            columns.append(F.struct(*[v.alias(out) for v, out in zip(values, part.values)]).alias(row))
            columns.append(F.struct(*[t.alias(f"t{k}") for k, t in enumerate(ties)]).alias(order))
            picks[row] = list(part.values)
            aggregates[row] = F.min_by(row, order)
        stacked.append(part.df.select(*columns))
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    merged = tall.groupBy(*keys).agg(F.max("_index").alias("_index"), *[a.alias(o) for o, a in aggregates.items()])
    if not all(p.index for p in parts):
        merged = merged.where(F.col("_index") == 1)
    return merged.select(*keys, *[F.col(row)[out].alias(out) for row, outs in picks.items() for out in outs])


def master_index(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*keys) for f in frames]).distinct()


def combine_static(parts: Sequence[Part], key: str = "station_id") -> DataFrame:
    """Full outer combination of static tables: one row per station of any table."""
    return merge_parts(parts, [key])


def left_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with a table that is unique per key; never grows ``df``.

    No hint: Spark broadcasts the table only when its measured size is under the threshold, and otherwise
    splits hot keys of ``df`` at run time.
    """
    return df.join(table, list(keys), "left")


def wide_table(sources: Mapping[str, tuple[SourceSpec, DataFrame]], observations: DataFrame | None = None,
               observation_order: str | None = None, altitude: DataFrame | None = None,
               coordinates: Sequence[DataFrame] = ()) -> DataFrame:
    """The ``(station_id, date)`` feature table of all sources.

    Dynamic sources and observations define the rows; GLDAS and phenology sources add columns only; static
    sources are combined and copied to every date; yearly sources join on station and year.
    """
    dated, static, yearly = [], [], []
    for spec, df in sources.values():
        part = Part(df, value_names(spec), spec.order, index=spec.kind not in ("gldas", "phenology"))
        if spec.kind in ("dynamic", "gldas", "phenology"):
            dated.append(part)
        elif spec.kind == "static":
            static.append(part)
        else:
            yearly.append(part)
    if observations is not None:
        dated.append(Part(observations, {"swe": "swe"}, observation_order))
    if not any(p.index for p in dated):
        return static_only(static, yearly)
    if altitude is not None:
        mean = altitude.groupBy("station_id").agg(F.avg("altitude").alias("altitude"))
        static.append(Part(mean, {"altitude": "altitude"}))
    wide = merge_parts(dated)
    # one station table and one join: joins in a row on the same key would keep a hot station in one task
    station = [combine_static(static)] if static else []
    if coordinates:
        station.append(best_coordinates(coordinates))
    if station:
        wide = left_lookup(wide, reduce(lambda a, b: a.join(b, "station_id", "full_outer"), station), ["station_id"])
    if yearly:
        per_year = merge_parts(yearly, ["station_id", "year"])
        wide = left_lookup(wide.withColumn("year", F.year("date")), per_year, ["station_id", "year"])
    return _fill_coordinates(wide) if coordinates else wide


def static_only(static: Sequence[Part], yearly: Sequence[Part] = ()) -> DataFrame:
    """Outer combination when no source has dates."""
    base = combine_static(static) if static else None
    if not yearly:
        if base is None:
            raise ValueError("no sources")
        return base
    per_year = merge_parts(yearly, ["station_id", "year"])
    return per_year if base is None else per_year.join(base, "station_id", "full_outer")


def first_per_station(df: DataFrame, yearly: DataFrame, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Parity form of the yearly join: the station's first row is used for every year."""
    first = keep_first(yearly.select("station_id", *values, *[o for o in order if o not in values]),
                       ["station_id"], order)
    return left_lookup(df, first.select("station_id", *values), ["station_id"])


def best_coordinates(sources: Sequence[DataFrame], lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """``station_id, _c`` with each station's pair from the first source, in the given order, that knows it."""
    ranked = reduce(DataFrame.unionByName, [
        s.select("station_id", F.struct(F.lit(i).alias("p"), F.col(lon).alias("x"), F.col(lat).alias("y")).alias("c"))
        .where(F.col(lon).isNotNull() & F.col(lat).isNotNull()) for i, s in enumerate(sources)])
    return ranked.groupBy("station_id").agg(F.min("c").alias("_c"))


def _fill_coordinates(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    have = {c: F.col(c) if c in df.columns else F.lit(None).cast("double") for c in (lon, lat)}
    return df.withColumns({
        lon: F.coalesce(have[lon], F.col("_c")["x"]), lat: F.coalesce(have[lat], F.col("_c")["y"])}).drop("_c")


def backfill_coordinates(df: DataFrame, sources: Sequence[DataFrame], lon: str = "longitude",
                         lat: str = "latitude") -> DataFrame:
    """Fill coordinates from the first source, in the given order, that knows a station's pair."""
    return _fill_coordinates(left_lookup(df, best_coordinates(sources, lon, lat), ["station_id"]), lon, lat)


def overwrite_protected(base: DataFrame, reference: DataFrame, columns: Sequence[str], base_order: Sequence[str],
                        reference_order: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Replace protected columns where the reference has a value; both sides keep one row per key."""
    ref = keep_first(reference.select(*keys, *columns, *[o for o in reference_order if o not in columns]), keys,
                     reference_order).select(*keys, *[F.col(c).alias(f"_ref_{c}") for c in columns])
    joined = left_lookup(keep_first(base, keys, base_order), ref, keys)
    return joined.withColumns({c: F.coalesce(f"_ref_{c}", c) for c in columns}).drop(*[f"_ref_{c}" for c in columns])


def latest_per_station(df: DataFrame, order: Sequence[str | Column], station: str = "station_id") -> DataFrame:
    return keep_first(df, [station], order, last=True)


def all_at_latest_date(df: DataFrame, station: str = "station_id", date: str = "date") -> DataFrame:
    """Every row of a station's last date."""
    last = df.groupBy(station).agg(F.max(date).alias(date))
    return df.join(last, [station, date], "left_semi")


def missing_stations(df: DataFrame, known: DataFrame, key: str = "station_id") -> DataFrame:
    return df.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def station_match(left: DataFrame, right: DataFrame, key: str = "station_id") -> DataFrame:
    """Stations in both tables, only left, only right, from one aggregate over both."""
    seen = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy(key).agg(
        F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("common"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("only_left"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("only_right"))


def complete_static(dynamic: Sequence[DataFrame], static: DataFrame, key: str = "station_id") -> DataFrame:
    """A static row, possibly empty, for every dynamic station."""
    ids = reduce(DataFrame.unionByName, [d.select(key) for d in dynamic]).distinct()
    return left_lookup(ids, static, [key])


def inner_by_location(dated: Sequence[DataFrame], static: DataFrame, digits: int = 6, lon: str = "longitude",
                      lat: str = "latitude", date: str = "date") -> DataFrame:
    """Inner join of products on rounded coordinates and date, then with a table on coordinates alone."""
    def rounded(df: DataFrame) -> DataFrame:
        return df.withColumns({lon: F.round(lon, digits), lat: F.round(lat, digits)})

    merged = reduce(lambda a, b: a.join(b, [lat, lon, date]), [rounded(d) for d in dated])
    return merged.join(rounded(static), [lat, lon])


def representative_dates(station_years: DataFrame, df: DataFrame, month: int = 6, day: int = 15) -> DataFrame:
    """First observed date of each station and year, else the middle of the year."""
    seen = df.select("station_id", F.year("date").alias("year"), "date").groupBy("station_id", "year").agg(
        F.min("date").alias("_seen"))
    joined = left_lookup(station_years, seen, ["station_id", "year"])
    return joined.withColumn("date", F.coalesce("_seen", F.make_date("year", F.lit(month), F.lit(day)))).drop("_seen")


def attach_extracted(observations: DataFrame, extracted: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Values extracted elsewhere joined back on station and date."""
    one = keep_first(extracted.select(*KEYS, value, *[o for o in order if o != value]), KEYS, order)
    return left_lookup(observations, one.select(*KEYS, value), KEYS)


def attach_cluster(df: DataFrame, clusters: DataFrame, key: str = "station_id", cluster: str = "cluster") -> DataFrame:
    """Cluster of each row's station; rows without one share the number after the largest."""
    top = one_row(clusters.agg(F.coalesce(F.max(cluster), F.lit(-1)).alias("top")))
    joined = left_lookup(df, clusters.select(key, cluster), [key])
    return joined.withColumn(cluster, F.coalesce(F.col(cluster), top.getField("top") + 1))


def attach_by_id(df: DataFrame, weights: DataFrame, key: str = "id") -> DataFrame:
    """Weight rows joined to their records by id, never by position."""
    return left_lookup(df, weights, [key])


def within_year_range(df: DataFrame, validation: DataFrame, year: str = "year") -> DataFrame:
    """Rows whose year lies inside the years of another split."""
    span = one_row(validation.agg(F.min(year).alias("lo"), F.max(year).alias("hi")))
    return df.where(F.col(year).between(span.getField("lo"), span.getField("hi")))


def stack_sources(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Long union with a source column; absent columns are NULL."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
