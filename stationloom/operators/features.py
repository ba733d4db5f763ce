"""Encoders, imputation, scaling and feature weighting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom.functions import scalar
from stationloom.functions.scalar import known
from stationloom.operators.quality import tall
from stationloom.operators.ranking import exact_quantiles, one_row

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
# Columns that are never features.
NOT_FEATURES = ("station_id", "date", "swe", "hydrological_doy", "id")


def feature_columns(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES,
                    exclude_prefixes: Sequence[str] = ("landuse_hash_",)) -> list[str]:
    return [c for c, t in df.dtypes if c not in exclude and t in NUMERIC
            and not any(c.startswith(p) for p in exclude_prefixes)]


def physical_features(df: DataFrame, aspect: str = "aspect", slope: str = "slope", elevation: str = "elevation",
                      date: str | None = "date") -> DataFrame:
    columns = {
        "northness": F.cos(F.radians(aspect)), "eastness": F.sin(F.radians(aspect)),
        "elevation_slope": F.col(elevation) * F.col(slope)}
    if date:
        columns |= {"doy": F.dayofyear(date), "month": F.month(date)}
    return df.withColumns(columns)


def default_columns(df: DataFrame, required: Sequence[str], date: str = "date") -> DataFrame:
    """Absent model columns become 0, absent time parts are taken from the date."""
    parts = {"year": F.year, "month": F.month, "doy": F.dayofyear}
    absent = [c for c in required if c not in df.columns]
    return df.withColumns({
        c: parts[c](F.col(date)).cast("double") if c in parts and date in df.columns else F.lit(0.0).cast("double")
        for c in absent}) if absent else df


def known_codes(df: DataFrame, column: str, limit: int | None = None) -> list:
    """Distinct codes in order; more than a stated ``limit`` raises. Each code becomes a column of the encoding."""
    codes = df.select(column).where(F.col(column).isNotNull()).distinct()
    rows = codes.collect() if limit is None else codes.limit(limit + 1).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories; use hash_encode")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, column: str, codes: Sequence | None = None, prefix: str = "landuse",
            limit: int | None = None) -> DataFrame:
    """``<prefix>_<code>`` indicators; NULL has no indicator set. More classes than a stated ``limit`` are refused."""
    codes = known_codes(df, column, limit) if codes is None else codes
    return df.withColumns({f"{prefix}_{c}": F.when(F.col(column) == c, 1).otherwise(0) for c in codes})


def hash_encode(df: DataFrame, column: str = "landuse_code", n_features: int = 10,
                prefix: str = "landuse_hash") -> DataFrame:
    bucket, sign = scalar.class_hash(F.col(column), n_features)
    return df.withColumns({
        f"{prefix}_{i}": F.when(bucket == i, sign).otherwise(0).cast("double") for i in range(n_features)})


def frequency_encode(df: DataFrame, column: str = "landuse_code", name: str | None = None) -> DataFrame:
    """Share of a class among the known values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(column).alias("n")).scalar()
    return df.join(counts, column, "left").withColumn(
        name or f"{column}_freq", F.col("_n") / total.cast("double")).drop("_n")


def target_encode(df: DataFrame, column: str = "landuse_code", target: str = "swe", smoothing: float = 10.0,
                  name: str | None = None) -> DataFrame:
    """Class mean of the target pulled to the overall mean by ``smoothing`` pseudo-rows."""
    value = known(F.col(target))
    overall = df.agg(F.avg(value).alias("m")).scalar()
    stats = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(value).alias("_n"), F.sum(value).alias("_s"))
    # a class without any target has no mean and so no code
    smooth = (F.col("_s") + smoothing * overall) / (F.col("_n") + smoothing)
    return df.join(stats, column, "left").withColumn(name or f"{column}_target", smooth).drop("_n", "_s")


def composite_encode(df: DataFrame, column: str = "landuse_code", methods: Sequence[str] = ("hashing", "frequency"),
                     n_features: int = 10, target: str = "swe") -> DataFrame:
    for method in methods:
        if method == "hashing":
            df = hash_encode(df, column, n_features)
        elif method == "frequency":
            df = frequency_encode(df, column)
        elif method == "target":
            df = target_encode(df, column, target) if target in df.columns else df
        else:
            raise ValueError(f"unknown encoding {method!r}")
    return df


def encoding_advice(df: DataFrame, column: str = "landuse_code") -> DataFrame:
    """Recommended encoding by the number of classes."""
    n = F.col("n_classes")
    return df.agg(F.count_distinct(column).alias("n_classes"), F.count_if(F.col(column).isNull()).alias("missing")
                  ).withColumn("advice", F.when(n <= 10, "onehot").when(n <= 50, "hash_8_16").otherwise("hash_16_32"))


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians of several columns as one row."""
    medians = exact_quantiles(tall(df, columns, "_column", "_value"), "_value", {"_median": 0.5}, ["_column"])
    return medians.agg(*[F.max(F.when(F.col("_column") == c, F.col("_median"))).alias(c) for c in columns])


def column_mode(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value, the smallest among ties, as one row."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column))


def impute(df: DataFrame, numeric: Sequence[str], text: Sequence[str] = (), strategy: str = "auto") -> DataFrame:
    """Fill missing values by column. ``auto`` is the median below 5 % missing and the mean above."""
    if strategy not in ("auto", "mean", "median"):
        raise ValueError(f"unknown strategy {strategy!r}")
    fills: dict[str, Column] = {}
    kinds = dict(df.dtypes)
    df = df.withColumns({c: known(F.col(c)) for c in numeric if kinds[c] in ("double", "float")})
    if numeric and strategy != "median":
        means = one_row(df.agg(F.count(F.lit(1)).alias("_rows"), *[
            F.struct(F.count(c).alias("n"), F.avg(c).alias("mean")).alias(c) for c in numeric]))
    if numeric and strategy != "mean":
        medians = one_row(column_medians(df, numeric))
    for c in numeric:
        if strategy == "mean":
            fills[c] = means.getField(c).getField("mean")
        elif strategy == "median":
            fills[c] = medians.getField(c)
        else:
            missing = 1 - means.getField(c).getField("n") / means.getField("_rows")
            fills[c] = F.when(missing < 0.05, medians.getField(c)).otherwise(means.getField(c).getField("mean"))
    for c in text:
        fills[c] = F.coalesce(column_mode(df, c).scalar(), F.lit("Unknown"))
    return df.withColumns({c: F.coalesce(F.col(c), fill) for c, fill in fills.items()})


@dataclass(frozen=True)
class MissingPlan:
    """Fill values fitted on training rows and replayed elsewhere; ``drop`` removes training rows only."""

    strategy: str
    fills: Mapping[str, object]
    numeric: tuple[str, ...]

    def training(self, df: DataFrame) -> DataFrame:
        df = df.dropna(subset=list(self.numeric)) if self.strategy == "drop" else df        # NaN goes as well
        return df.fillna(dict(self.fills))

    def replay(self, df: DataFrame) -> DataFrame:
        return df.fillna(dict(self.fills))


def fit_missing(train: DataFrame, numeric: Sequence[str], text: Sequence[str] = (), strategy: str = "median",
                constant: float = 0.0, max_classes: int = 50) -> MissingPlan:
    """Only one row of statistics per call reaches the driver. NaN is missing.

    A text column of ``max_classes`` values or more is filled with ``MISSING`` and not with its mode.
    """
    fills: dict[str, object] = {}
    train = train.withColumns({c: known(F.col(c)) for c in numeric})
    if strategy == "mean":
        fills |= train.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict()
    elif strategy == "median":
        fills |= column_medians(train, numeric).first().asDict()
    elif strategy in ("zero", "constant", "drop"):
        fills |= {c: 0.0 if strategy == "zero" else constant for c in numeric}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    fills = {c: (constant if v is None else v) for c, v in fills.items()}
    for c in text:
        few = train.select(c).distinct().limit(max_classes).count() < max_classes
        mode = column_mode(train, c).first()[0] if few else None
        fills[c] = "MISSING" if mode is None else mode
    return MissingPlan(strategy, fills, tuple(numeric))


def scale_like(train: DataFrame, df: DataFrame, columns: Sequence[str], method: str = "minmax",
               epsilon: float = 1e-8) -> DataFrame:
    """Scale ``df`` with the statistics of the training rows; NaN is missing and becomes NULL, and so
    does a column without spread where ``epsilon`` is 0."""
    x = {c: known(F.col(c)) for c in columns}
    if method == "minmax":
        stats = one_row(train.agg(*[F.struct(F.min(x[c]).alias("a"), F.max(x[c]).alias("b")).alias(c) for c in columns]))

        def scaled(c: str) -> Column:
            a, b = stats.getField(c).getField("a"), stats.getField(c).getField("b")
            return F.try_divide(x[c] - a, b - a + epsilon)
    elif method == "standard":
        stats = one_row(train.agg(*[F.struct(F.avg(x[c]).alias("a"), F.stddev_pop(x[c]).alias("b")).alias(c)
                                    for c in columns]))

        def scaled(c: str) -> Column:
            return F.try_divide(x[c] - stats.getField(c).getField("a"), stats.getField(c).getField("b") + epsilon)
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumns({c: scaled(c) for c in columns})


def weighted_features(features: DataFrame, weights: DataFrame, key: str = "id", x: str = "features",
                      w: str = "weights", out: str = "weighted") -> DataFrame:
    """Features times weights of the same id; rows without weights stay as they are."""
    joined = features.join(weights.select(key, w), key, "left")
    return joined.withColumn(out, F.when(F.col(w).isNull(), F.col(x)).otherwise(
        scalar.weight_vector(F.col(x), F.col(w))))
