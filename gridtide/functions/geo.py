"""Geometry as column expressions: longitudes, areas, buckets, projections."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius for areas, and the sphere of the Lambert source product, in metres.
EARTH_RADIUS_M = 6_371_008.8
LAMBERT_RADIUS_M = 6_371_229.0


def normalize_longitude(lon: Column | str) -> Column:
    """Longitude in [0, 360)."""
    return F.pmod(_col(lon), F.lit(360e0))


def display_longitude(lon: Column | str) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_col(lon) + 180e0, F.lit(360e0)) - 180e0


def unwrap_longitude(lon: Column, centre: Column) -> Column:
    """The equivalent longitude nearest to ``centre``."""
    return lon - 360e0 * F.round((lon - centre) / 360e0)


def cell_area(lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Spherical area of a latitude/longitude cell; latitudes are clipped to the poles."""
    clip = lambda x: F.least(F.greatest(x, F.lit(-90e0)), F.lit(90e0))
    bands = F.abs(F.sin(F.radians(clip(lat_hi))) - F.sin(F.radians(clip(lat_lo))))
    return F.lit(radius * radius) * bands * F.abs(F.radians(lon_hi - lon_lo))


def fallback_area(lat: Column) -> Column:
    """Relative weight of a cell whose area is unknown: cos(lat), never negative."""
    return F.greatest(F.cos(F.radians(lat)), F.lit(0e0))


def circular_mean(lon: Column | str) -> Column:
    """Aggregate: mean direction of longitudes, in [0, 360)."""
    angle = F.radians(_col(lon))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))), F.lit(360e0))


@dataclass(frozen=True)
class BucketGrid:
    """Fixed global tiles; the northern edge belongs to the top row."""

    lon_min: float = 0.0
    lat_min: float = -90.0
    lon_size: float = 60.0
    lat_size: float = 30.0

    def __post_init__(self) -> None:
        if self.lon_size <= 0 or 360 % self.lon_size:
            raise ValueError("lon_size must divide 360")
        if self.lat_size <= 0 or 180 % self.lat_size:
            raise ValueError("lat_size must divide 180")
        if self.lat_min != -90:
            raise ValueError("lat_min must be -90")

    @property
    def n_rows(self) -> int:
        return round(180 / self.lat_size)

    @property
    def n_cols(self) -> int:
        return round(360 / self.lon_size)

    def code(self, lat: Column | str, lon: Column | str) -> Column:
        """Row-major number of the tile that holds a point."""
        lat, lon = _col(lat), _col(lon)
        row = F.when(lat == 90, F.lit(self.n_rows - 1)).otherwise(F.floor((lat - self.lat_min) / self.lat_size))
        col = F.floor(F.pmod(lon - self.lon_min, F.lit(360e0)) / self.lon_size)
        return (row * self.n_cols + col).cast("int")

    def bucket_id(self, code: Column) -> Column:
        return F.format_string("r%d_c%d", F.floor(code / self.n_cols).cast("int"), (code % self.n_cols).cast("int"))

    def point(self, lat: float, lon: float) -> str:
        """Id of the tile that holds a point, on the driver."""
        row = self.n_rows - 1 if lat == 90 else math.floor((lat - self.lat_min) / self.lat_size)
        if not 0 <= row < self.n_rows:
            raise ValueError("latitude outside [-90, 90]")
        return f"r{row}_c{math.floor(((lon - self.lon_min) % 360) / self.lon_size)}"

    def table(self, spark):
        """A row per tile: ``code, bucket_id, lat_min, lat_max, lon_min, lon_max``."""
        row, col = F.floor(F.col("id") / self.n_cols), F.col("id") % self.n_cols
        lat, lon = row * self.lat_size + self.lat_min, col * self.lon_size + self.lon_min
        return spark.range(self.n_rows * self.n_cols).select(
            F.col("id").cast("int").alias("code"), self.bucket_id(F.col("id")).alias("bucket_id"),
            lat.cast("double").alias("lat_min"), (lat + self.lat_size).cast("double").alias("lat_max"),
            lon.cast("double").alias("lon_min"), (lon + self.lon_size).cast("double").alias("lon_max"),
        )


@dataclass(frozen=True)
class Lambert:
    """A Lambert conformal conic projection of the sphere (Snyder 1987), angles in degrees."""

    lat_1: float
    lat_2: float
    lat_0: float
    lon_0: float
    radius: float = LAMBERT_RADIUS_M
    false_easting: float = 0.0
    false_northing: float = 0.0

    @property
    def constants(self) -> tuple[float, float, float]:
        """Cone constant n, factor F and the radius rho of the origin."""
        p1, p2 = math.radians(self.lat_1), math.radians(self.lat_2)
        half = lambda p: math.tan(math.pi / 4 + p / 2)
        n = math.sin(p1) if self.lat_1 == self.lat_2 else math.log(math.cos(p1) / math.cos(p2)) / math.log(half(p2) / half(p1))
        f = math.cos(p1) * half(p1) ** n / n
        return n, f, self.radius * f / half(math.radians(self.lat_0)) ** n

    def forward(self, lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
        """Projected x and y in metres."""
        n, f, rho_0 = self.constants
        rho = F.lit(self.radius * f) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(_col(lat)) / 2), F.lit(n))
        theta = F.lit(n) * F.radians(F.pmod(_col(lon) - self.lon_0 + 180e0, F.lit(360e0)) - 180e0)
        return self.false_easting + rho * F.sin(theta), self.false_northing + rho_0 - rho * F.cos(theta)

    def inverse(self, x: Column | str, y: Column | str) -> tuple[Column, Column]:
        """Latitude and longitude in [0, 360), for a cone constant above 0."""
        n, f, rho_0 = self.constants
        x, y = _col(x) - self.false_easting, F.lit(rho_0) - (_col(y) - self.false_northing)
        rho = F.sqrt(x * x + y * y)
        lat = F.degrees(2 * F.atan(F.pow(F.lit(self.radius * f) / rho, F.lit(1 / n))) - math.pi / 2)
        return lat, F.pmod(F.degrees(F.atan2(x, y)) / n + self.lon_0, F.lit(360e0))

    def origin(self, lat: float, lon: float) -> tuple[float, float]:
        """Projected place of one point, on the driver (the first point of a grid)."""
        n, f, rho_0 = self.constants
        rho = self.radius * f / math.tan(math.pi / 4 + math.radians(lat) / 2) ** n
        theta = n * math.radians((lon - self.lon_0 + 180) % 360 - 180)
        return self.false_easting + rho * math.sin(theta), self.false_northing + rho_0 - rho * math.cos(theta)

    def axes(self, first: tuple[float, float], nx: int, ny: int, dx: float, dy: float, i_negative: bool = False, j_positive: bool = True) -> tuple[list[float], list[float]]:
        """The projected axes of a grid from its first point, steps and scan directions."""
        x0, y0 = self.origin(*first)
        dx, dy = -dx if i_negative else dx, dy if j_positive else -dy
        return [x0 + k * dx for k in range(nx)], [y0 + k * dy for k in range(ny)]


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
