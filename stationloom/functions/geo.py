"""Grid addressing, great-circle distance and the two closed-form map projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0  # fixed value: sphere radius of the great-circle distance


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def affine_col(lon: Column, x0: float, cell: float) -> Column:
    return F.floor((lon - x0) / cell).cast("int")


def affine_row(lat: Column, y0: float, cell: float) -> Column:
    """Row counted southward from the northern edge ``y0``."""
    return F.floor((y0 - lat) / cell).cast("int")


def nearest_index(value: Column, first: float, step: float) -> Column:
    """Index of the nearest position on an even axis; halves go up."""
    return F.floor((value - first) / step + 0.5).cast("int")


def laea(lat: Column, lon: Column, lat0: float = 90.0, lon0: float = 0.0, radius: float = 6371228.0,
         x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area on a sphere (Snyder 1987, 24-2 to 24-4)."""
    phi, dlam, phi0 = F.radians(lat), F.radians(lon - lon0), math.radians(lat0)
    sin0, cos0 = math.sin(phi0), 0.0 if abs(lat0) == 90.0 else math.cos(phi0)
    k = F.sqrt(2 / (1 + sin0 * F.sin(phi) + cos0 * F.cos(phi) * F.cos(dlam)))
    x = x0 + radius * k * F.cos(phi) * F.sin(dlam)
    y = y0 + radius * k * (cos0 * F.sin(phi) - sin0 * F.cos(phi) * F.cos(dlam))
    return x, y


def albers(lat: Column, lon: Column, lat1: float, lat2: float, lat0: float, lon0: float,
           semi_major: float = 6378137.0, inv_flattening: float | None = 298.257222101,
           x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    """Albers equal-area conic (Snyder 1987, 14-1 to 14-21); ``inv_flattening=None`` means a sphere."""
    f = 0.0 if inv_flattening is None else 1.0 / inv_flattening
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q_number(deg: float) -> float:
        s = math.sin(math.radians(deg))
        if e == 0:
            return 2 * s
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_number(deg: float) -> float:
        s = math.sin(math.radians(deg))
        return math.cos(math.radians(deg)) / math.sqrt(1 - e2 * s * s)

    m1, m2, q0, q1, q2 = m_number(lat1), m_number(lat2), q_number(lat0), q_number(lat1), q_number(lat2)
    n = math.sin(math.radians(lat1)) if lat1 == lat2 else (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    rho0 = semi_major * math.sqrt(c - n * q0) / n
    s = F.sin(F.radians(lat))
    if e == 0:
        q = 2 * s
    else:
        q = (1 - e2) * (s / (1 - e2 * s * s) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = semi_major * F.sqrt(c - n * q) / n, n * F.radians(lon - lon0)
    return x0 + rho * F.sin(theta), y0 + rho0 - rho * F.cos(theta)


def tile_key(value: Column, origin: float, size: float = 5.0) -> Column:
    return F.floor((value - origin) / size).cast("int")


def tile_grid(bounds: DataFrame, size: float = 5.0) -> DataFrame:
    """Fixed-size tiles over each bounding box (``west, south, east, north``), clipped at the east and north edge."""
    def steps(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.floor((F.col(hi) - F.col(lo)) / size).cast("int")))

    tiles = bounds.withColumn("tile_x", steps("west", "east")).withColumn("tile_y", steps("south", "north"))
    return tiles.select(
        "tile_x", "tile_y",
        (F.col("west") + F.col("tile_x") * size).alias("lon_min"),
        F.least(F.col("west") + (F.col("tile_x") + 1) * size, F.col("east")).alias("lon_max"),
        (F.col("south") + F.col("tile_y") * size).alias("lat_min"),
        F.least(F.col("south") + (F.col("tile_y") + 1) * size, F.col("north")).alias("lat_max"),
    ).where((F.col("lon_min") < F.col("lon_max")) & (F.col("lat_min") < F.col("lat_max")))
