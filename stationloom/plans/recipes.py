"""Named, versioned steps chained as DataFrame transforms.

A recipe runs as one plan with nothing written between its steps. ``observed`` counts rows and missing cells of every
step within that one run; ``staged`` writes each step, which also tells how long each took.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stationloom.functions.scalar import known
from stationloom.operators import features, filters, quality

Step = Callable[..., DataFrame]
STEPS: dict[tuple[str, str], Step] = {}
REPORTS: dict[tuple[str, str], Callable[..., dict[str, DataFrame]]] = {}
SUMMARY = "position int, step string, version string, columns int, rows long, missing long, seconds double"


def step(name: str, version: str = "v1") -> Callable[[Step], Step]:
    def register(fn: Step) -> Step:
        STEPS[(name, version)] = fn
        return fn

    return register


def find_step(name: str, version: str = "v1") -> Step:
    try:
        return STEPS[(name, version)]
    except KeyError:
        raise ValueError(f"unknown step {name}/{version}") from None


# Columns the repair step removes.
DROPPED = ("landuse_class", "longitude_x", "latitude_x")


@step("data_fixer", "v1")
def fix_data(df: DataFrame, order: str = "date", station: str = "station_id") -> DataFrame:
    """Station-constant classes filled, leftover columns dropped, acquisition dates removed."""
    classes = [c for c in df.columns if "landuse" in c.lower()]
    fixed = quality.fill_station_nulls(df, classes, order, station) if classes else df
    return filters.drop_bad_dates(fixed.drop(*DROPPED)) if "date" in df.columns else fixed.drop(*DROPPED)


@step("feature_encoder", "hashing")
def encode_hashing(df: DataFrame, column: str = "landuse_code", n_features: int = 12) -> DataFrame:
    return features.hash_encode(df, column, n_features)


@step("feature_encoder", "composite")
def encode_composite(df: DataFrame, column: str = "landuse_code", methods: tuple = ("hashing", "frequency")
                     ) -> DataFrame:
    return features.composite_encode(df, column, methods)


@step("feature_encoder", "onehot")
def encode_onehot(df: DataFrame, column: str = "landuse_code", codes: tuple | None = None) -> DataFrame:
    return features.one_hot(df, column, codes)


@step("data_analyzer", "basic")
def analyze(df: DataFrame, column: str = "landuse_code", station: str = "station_id") -> DataFrame:
    """The data pass through unchanged; ``Recipe.reports`` gives what the step finds in them."""
    return df


def _reports(df: DataFrame, column: str = "landuse_code", station: str = "station_id") -> dict[str, DataFrame]:
    """What a repair would change, the classes of every class column, their agreement inside stations, an encoding."""
    classes = [c for c in df.columns if "landuse" in c.lower()]
    bad = F.count_if(filters.is_bad_date(F.col("date"))) if "date" in df.columns else F.lit(0).cast("long")
    found = {"repair_preview": df.agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(station).alias("stations"), bad.alias("bad_dates"),
        F.lit(",".join(c for c in DROPPED if c in df.columns)).alias("columns_to_drop"))}
    if classes:
        # one pass for all class columns
        tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("class"))
                                             for c in classes])).alias("r")).select("r.column", "r.class")
        total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        found["class_distribution"] = tall.groupBy("column", "class").agg(F.count(F.lit(1)).alias("records")).withColumn(
            "pct", F.col("records") * 100.0 / total)
        found["station_consistency"] = quality.consistency(df, classes, station)
    if column in df.columns:
        found["encoding_advice"] = features.encoding_advice(df, column)
    return found


REPORTS[("data_analyzer", "basic")] = _reports


def _missing(df: DataFrame) -> Column:
    """Missing cells of all columns of a frame; NaN is missing too."""
    total = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        cell = F.col("`" + name.replace("`", "``") + "`")
        total = total + F.count_if((known(cell) if kind in ("double", "float") else cell).isNull())
    return total


@dataclass(frozen=True)
class Recipe:
    steps: tuple[tuple[str, str, dict], ...] = field(default_factory=tuple)

    def add(self, name: str, version: str = "v1", **settings) -> Recipe:
        find_step(name, version)
        return Recipe((*self.steps, (name, version, settings)))

    def run(self, df: DataFrame) -> DataFrame:
        for name, version, settings in self.steps:
            df = df.transform(find_step(name, version), **settings)
        return df

    def reports(self, df: DataFrame) -> dict[str, DataFrame]:
        """The reports of all reporting steps on the data as they are at that place, by ``position_step/report``."""
        found = {}
        for i, (name, version, settings) in enumerate(self.steps):
            if (name, version) in REPORTS:
                found.update({f"{i + 1}_{name}/{report}": frame
                              for report, frame in REPORTS[(name, version)](df, **settings).items()})
            df = df.transform(find_step(name, version), **settings)
        return found

    def observed(self, df: DataFrame, action: Callable[[DataFrame], object]) -> DataFrame:
        """Run ``action`` once on the result and return a row per step, the input first as step 0.

        Rows and missing cells are counted inside that run, so no step is computed twice for its summary. ``action``
        has to read the result whole, as a write does. ``seconds`` of a step is the time to plan it, jobs of its own
        included; ``seconds`` of step 0 is that of the run. An empty table gives zeros.
        """
        taken, counts, spark = [], [], df.sparkSession
        for i, (name, version, settings) in enumerate((("input", "", {}), *self.steps)):
            start = time.perf_counter()
            if i:
                df = df.transform(find_step(name, version), **settings)
            taken.append((i, name, version, len(df.columns), time.perf_counter() - start))
            counts.append(Observation())
            df = df.observe(counts[-1], F.count(F.lit(1)).alias("rows"), _missing(df).alias("missing"))
        start = time.perf_counter()
        action(df)
        ran = time.perf_counter() - start
        seen = [c.get for c in counts]
        return spark.createDataFrame([(i, name, version, columns, c["rows"], c["missing"], seconds if i else ran)
                                      for (i, name, version, columns, seconds), c in zip(taken, seen)], SUMMARY)

    def staged(self, df: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
        """Write every step as Parquet to ``folder/<position>_<step>`` and go on from the file.

        Returns the result and a row per step with the seconds it took by itself. A step that fails leaves those
        before it readable. ``folder`` must be one that all executors share, and new: an existing step is an error.
        """
        rows, spark = [], df.sparkSession
        for i, (name, version, settings) in enumerate(self.steps):
            start, count = time.perf_counter(), Observation()
            after = df.transform(find_step(name, version), **settings)
            path = f"{folder.rstrip('/')}/{i + 1:02d}_{name}"
            after.observe(count, F.count(F.lit(1)).alias("rows"), _missing(after).alias("missing")).write.parquet(path)
            df = spark.read.schema(after.schema).parquet(path)
            rows.append((i + 1, name, version, len(after.columns), count.get["rows"], count.get["missing"],
                         time.perf_counter() - start))
        return df, spark.createDataFrame(rows, SUMMARY)

    def summary(self, df: DataFrame) -> DataFrame:
        """Position, step, version and column counts of a run; built from the plan, no data is read."""
        rows = []
        for i, (name, version, settings) in enumerate(self.steps):
            after = df.transform(find_step(name, version), **settings)
            rows.append((i + 1, name, version, len(df.columns), len(after.columns)))
            df = after
        return df.sparkSession.createDataFrame(
            rows, "position int, step string, version string, columns_in int, columns_out int")


def basic_clean_encode() -> Recipe:
    return Recipe().add("data_fixer").add("feature_encoder", "hashing", n_features=10)


def advanced_analysis() -> Recipe:
    return Recipe().add("data_analyzer", "basic").add("data_fixer").add("feature_encoder", "composite")


def quick_fix() -> Recipe:
    return Recipe().add("data_fixer")
