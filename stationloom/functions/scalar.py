"""Value-level expressions: ids, dates, masks, unit conversion, transforms and weighting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/M/d", "yyyyMMdd")


def canonical_id(value: Column) -> Column:
    """``123``, ``123.0`` and ``"123.0"`` become ``"123"``; other text is kept trimmed.

    Only digits with a zero fraction count as a number: ``12D``, ``7f`` and ``1e3`` are names, and leading zeros of a
    text stay.
    """
    number = value.cast("string").try_cast("double")
    large = F.typeof(value).isin("double", "float") & (number == F.floor(number)) & (F.abs(number) < 1e15)
    text = F.when(large, number.try_cast("bigint").cast("string")).otherwise(F.trim(value.cast("string")))
    return F.regexp_replace(text, r"^(\d+)\.0+$", "$1")


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Day of a text date in the first format that fits; NULL when none does. ``T`` and ``/`` may stand in a date
    with a time."""
    iso = F.replace(F.trim(text), F.lit("/"), F.lit("-"))
    full = F.when(F.rlike(iso, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$")), iso.try_cast("timestamp"))
    return F.coalesce(full, *[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def decode_numeric_date(value: Column) -> Column:
    """``20140131`` or ``20140131.0`` as a date."""
    return F.try_to_timestamp(value.cast("bigint").cast("string"), F.lit("yyyyMMdd")).cast("date")


def year_doy_to_date(year: Column, doy: Column) -> Column:
    """Date of a day of year; NULL when the day does not exist in that year."""
    first = F.make_date(year.cast("int"), F.lit(1), F.lit(1))
    day = F.date_add(first, doy.cast("int") - 1)
    return F.when((doy >= 1) & (F.year(day) == year), day)


def coordinate(value: Column) -> Column:
    number = value.cast("string").try_cast("double")
    return F.when(~F.isnan(number), number)


def null_if(value: Column, *fills: float) -> Column:
    """Fill sentinels and NaN become NULL."""
    number = value.cast("double")
    bad = F.isnan(number)
    for fill in fills:
        bad = bad | (number == F.lit(fill).cast("double"))
    return F.when(~bad, number)


def known(value: Column) -> Column:
    """NaN of any numeric column becomes NULL; the type stays."""
    return F.when(~F.isnan(value.cast("double")), value)


def null_above(value: Column, limit: float = 200.0) -> Column:
    return F.when(value <= limit, value)


def scale_offset(value: Column, scale: float = 1.0, offset: float = 0.0, unit: str | None = None) -> Column:
    """``value*scale + offset``, and Kelvin to Celsius when the unit is ``K``."""
    out = value * F.lit(float(scale)) + F.lit(float(offset))
    return out - F.lit(273.15) if unit == "K" else out


def guarded_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * F.lit(100.0).cast("double") / whole)


def gaussian_weight(distance: Column, bandwidth: float) -> Column:
    return F.exp(-0.5 * F.pow(distance / bandwidth, 2))


def class_hash(value: Column, n_features: int) -> tuple[Column, Column]:
    """Portable feature hash: bucket and sign taken from the md5 of the text."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("unknown")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n_features
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return bucket, sign


def weight_vector(features: Column, weights: Column) -> Column:
    """Element-wise product; a missing weight counts as one."""
    return F.zip_with(features, weights, lambda x, w: x * F.coalesce(w, F.lit(1.0)))


def weight_columns(columns: Sequence[str], weights: Mapping[str, Column]) -> dict[str, Column]:
    """Per-column form: columns without a weight pass through."""
    return {c: F.col(c) * F.coalesce(weights[c], F.lit(1.0)) if c in weights else F.col(c) for c in columns}
