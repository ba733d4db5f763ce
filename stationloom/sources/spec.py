"""What a source is: its kind, value columns, mask and grid. Nothing is guessed from the data by default."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

KINDS = ("dynamic", "static", "yearly", "phenology", "gldas")


@dataclass(frozen=True)
class GridSpec:
    """Regular grid: ``x0`` west and ``y0`` north, either of the outer corner or of the first cell centre."""

    x0: float
    y0: float
    dx: float
    dy: float
    nrows: int
    ncols: int
    origin: str = "corner"

    @property
    def west(self) -> float:
        return self.x0 - self.dx / 2 if self.origin == "centre" else self.x0

    @property
    def north(self) -> float:
        return self.y0 + self.dy / 2 if self.origin == "centre" else self.y0


@dataclass(frozen=True)
class SourceSpec:
    name: str
    kind: str = "dynamic"
    values: tuple[str, ...] = ("value",)
    order: str | None = None             # decides which of several rows of a key is kept
    fill: float | None = None
    valid_min: float | None = None
    valid_max: float | None = None
    scale: float = 1.0
    offset: float = 0.0
    unit: str | None = None
    grid: GridSpec | None = None
    start: str | None = None
    end: str | None = None
    sampling: str = "affine"             # affine | axis | nearest
    every: str = "day"                   # day | month | year
    classes: dict[int, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")


# Fill, valid range, scale, period and classes of the published products.
DEFAULTS = {
    "cswe": SourceSpec("cswe", fill=-9999.0, valid_min=0.0, start="2013-01-02", end="2017-12-31", sampling="nearest"),
    "era5_swe": SourceSpec("era5_swe", fill=-32768.0, valid_min=0.0, start="2013-01-02", end="2017-12-31"),
    "era5_temperature": SourceSpec("era5_temperature", fill=-32768.0, scale=0.01, unit="K", start="2013-01-01",
                                   end="2017-12-31", every="month"),
    "glsnow": SourceSpec("glsnow", fill=-9999.0, valid_min=0.0, start="2013-01-02", end="2017-12-31",
                         sampling="axis"),
    "snow_depth": SourceSpec("snow_depth", fill=-1.0, start="2013-01-01", end="2017-12-31",
                             grid=GridSpec(60.0, 15.0 + 160 * 0.25, 0.25, 0.25, 161, 321, origin="centre")),
    "snow_phenology": SourceSpec("snow_phenology", kind="phenology", fill=-32768.0, valid_min=1, valid_max=366,
                                 start="2012-09-01", end="2018-08-31"),
    "landuse": SourceSpec("landuse", kind="static", fill=255, valid_min=11, valid_max=99, start="2013-01-02",
                          end="2017-12-31"),
    "terrain": SourceSpec("terrain", kind="static", fill=-9999.0),
    "landcover": SourceSpec("landcover", kind="yearly", fill=255, valid_min=1, start="2013-01-01", end="2017-12-31",
                            every="year", classes={
                                1: "Cropland", 2: "Forest", 3: "Shrub", 4: "Grassland", 5: "Water", 6: "Sonw/Ice",
                                7: "Barren", 8: "Impervious", 9: "Wetland"}),
}
SENSOR_PRIORITY = ("DMSP_SMMR", "F08_SSMI", "F13_SSMI", "F17_SSMIS")  # fixed values: first existing wins
TERRAIN_FEATURES = (  # fixed values
    "aspect", "slope", "eastness", "tpi", "curvature1", "curvature2", "elevation", "std_slope", "std_eastness",
    "std_tpi", "std_curvature1", "std_curvature2", "std_high", "std_aspect")


# Words in a source name and columns that decide its kind.
GLDAS_WORDS = ("gldas", "seasonal_doy")
GLDAS_COLUMNS = ("seasonal_doy_Da", "seasonal_doy_Db", "seasonal_doy_Dc", "seasonal_doy_Dd")
PHENOLOGY_WORDS = ("snow_phenology", "snow_start", "snow_end", "phenology", "scp")
TERRAIN_WORDS = ("terrain", "feature")
YEARLY_WORDS = ("landcover",)


def infer_kind(df: DataFrame, name: str = "") -> str:
    """Kind of a source nobody described, from its name and its columns; how many rows it has does not matter."""
    def named(words: tuple[str, ...]) -> bool:
        return any(w in name.lower() for w in words)

    columns = set(df.columns)
    if named(GLDAS_WORDS) or columns & set(GLDAS_COLUMNS):
        return "gldas"
    if named(PHENOLOGY_WORDS) or {"dataset_type", "hydrological_year"} <= columns:
        return "phenology"
    if "year" in columns and "date" not in columns and not named(TERRAIN_WORDS) and name != "landuse":
        return "yearly"
    numbers = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")
               and c not in ("station_id", "longitude", "latitude")]
    if named(TERRAIN_WORDS) or name == "landuse" or (len(numbers) > 1 and "date" not in columns):
        return "static"
    if named(YEARLY_WORDS):
        return "yearly"
    return "dynamic" if {"date", "station_id"} <= columns else "static"
