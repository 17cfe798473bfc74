"""From a provider's table to standard columns: ``ts, gy, gx, value`` and a grid.

A source is a long table (one row per sample) in any format that Spark reads.
Roles of its columns come from attributes in the schema's metadata (standard
name, units, axis) first and from names last.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ..functions.geo import cell_area, normalize_longitude
from ..operators.spatial import axis_bounds, sorted_axis_index
from ..operators.stats import missing_to_null

#: Names and attributes that tell a coordinate's role.
NAMES = {
    "timestamp": {"time", "timestamp", "valid_time", "date", "datetime", "ts"},
    "latitude": {"lat", "latitude", "nav_lat"},
    "longitude": {"lon", "longitude", "nav_lon"},
    "y": {"y", "projection_y_coordinate", "yc"},
    "x": {"x", "projection_x_coordinate", "xc"},
}
STANDARD_NAMES = {"time": "timestamp", "latitude": "latitude", "longitude": "longitude", "projection_y_coordinate": "y", "projection_x_coordinate": "x"}
UNITS = {"degrees_north": "latitude", "degree_north": "latitude", "degrees_east": "longitude", "degree_east": "longitude"}
AXES = {"T": "timestamp", "Y": "y", "X": "x"}


def coordinate_role(field: StructField) -> str | None:
    """The role of a column, or None for data."""
    attrs = field.metadata or {}
    if attrs.get("standard_name") in STANDARD_NAMES:
        return STANDARD_NAMES[attrs["standard_name"]]
    if attrs.get("units") in UNITS:
        return UNITS[attrs["units"]]
    if "since" in str(attrs.get("units", "")) or "calendar" in attrs:
        return "timestamp"
    if attrs.get("axis") in AXES:
        return AXES[attrs["axis"]]
    return next((role for role, names in NAMES.items() if field.name.lower() in names), None)


@dataclass
class Standardized:
    data: DataFrame  # ts, gy, gx, value
    grid: DataFrame  # gy, gx, lat, lon, cell_area and bounds
    grid_type: str
    variable: str
    constants: dict[str, object]


def open_sources(spark: SparkSession, paths: list[str], format: str = "parquet") -> DataFrame:
    """Adjacent files of one source as one table; absent columns are NULL."""
    if not paths:
        raise FileNotFoundError("no source files")
    if format == "netcdf":
        raise ImportError("reading NetCDF is not implemented; convert to Parquet first")
    frames = [spark.read.format(format).load(p) for p in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def standard_variable(name: str, mapping: dict[str, str], columns: list[str]) -> str:
    """A source variable's standard name."""
    if name not in mapping:
        raise ValueError(f"no standard name is configured for {name!r}")
    if name not in columns:
        raise ValueError(f"variable {name!r} is missing in the source")
    if mapping[name] != name and mapping[name] in columns:
        raise ValueError(f"standard name {mapping[name]!r} is already a column")
    return mapping[name]


def standardize(source: DataFrame, variable: str, mapping: dict[str, str]) -> Standardized:
    """Rename by role, wrap longitudes to [0, 360), sort axes, find constants, turn NaN to NULL.

    A source with projected ``x`` and ``y`` is projected, one with plain
    latitudes and longitudes rectilinear. Roles must be unique.
    """
    roles: dict[str, str] = {}
    for field in source.schema:
        role = coordinate_role(field) if field.name != variable else None
        if role in roles:
            raise ValueError(f"columns {roles[role]!r} and {field.name!r} have the same role {role}")
        if role:
            roles[role] = field.name
    if "timestamp" not in roles or not {"latitude", "longitude"} <= roles.keys():
        raise ValueError("a source needs time, latitude and longitude")
    name = standard_variable(variable, mapping, source.columns)
    projected = {"x", "y"} <= roles.keys()
    rest = [c for c in source.columns if c not in (*roles.values(), variable)]
    facts = source.agg(
        F.min(roles["latitude"]).alias("south"), F.max(roles["latitude"]).alias("north"),
        F.count_distinct(roles["longitude"]).alias("n_lon"), F.count_distinct(F.pmod(F.col(roles["longitude"]), F.lit(360e0))).alias("n_wrapped"),
        *(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))).alias(f"n_{c}") for c in rest), *(F.first(c).alias(f"v_{c}") for c in rest),
    ).first()
    if facts["south"] is not None and (facts["south"] < -90 or facts["north"] > 90):
        raise ValueError("latitudes must be in [-90, 90]")
    if not projected and facts["n_lon"] != facts["n_wrapped"]:
        raise ValueError("longitudes repeat after wrapping to [0, 360)")
    constants = {c: facts[f"v_{c}"] for c in rest if facts[f"n_{c}"] <= 1}
    rows = source.select(
        F.col(roles["timestamp"]).cast("timestamp_ntz").alias("ts"), F.col(roles["latitude"]).cast("double").alias("lat"), normalize_longitude(F.col(roles["longitude"]).cast("double")).alias("lon"),
        *(F.col(roles[c]).cast("double").alias(f"proj_{c}") for c in ("x", "y") if projected), missing_to_null(F.col(variable).cast("double")).alias("value"),
    )
    y, x = ("proj_y", "proj_x") if projected else ("lat", "lon")
    placed = sorted_axis_index(sorted_axis_index(rows, y, "gy"), x, "gx")
    cells = placed.groupBy("gy", "gx").agg(*(F.first(c).alias(c) for c in ("lat", "lon", *(("proj_x", "proj_y") if projected else ()))))
    for axis, index in ((y, "gy"), (x, "gx")):
        cells = cells.join(axis_bounds(cells.select(index, axis).distinct(), axis).drop(axis), index)
    if projected:
        area = F.abs(F.col("proj_y_hi") - F.col("proj_y_lo")) * F.abs(F.col("proj_x_hi") - F.col("proj_x_lo"))
    else:
        area = cell_area(*(F.col(c) for c in ("lat_lo", "lat_hi", "lon_lo", "lon_hi")))
    return Standardized(placed.select("ts", "gy", "gx", "value"), cells.withColumn("cell_area", area), "projected" if projected else "rectilinear", name, constants)


def write_standardized(made: Standardized, folder: str, record: dict, manifest: str, remove_sources: bool = False) -> dict:
    """Write samples and grid to a folder of their own, then append the record to a manifest of JSON lines.

    ``record`` names repository, dataset and ``file_paths``; the record that is
    written has the output's path, the standard variable, the grid type and the constants instead.
    Sources are removed last, and only if asked, so an error before leaves them.
    """
    spark = made.data.sparkSession
    out = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    made.grid.write.parquet(f"{out}/grid")
    made.data.write.parquet(f"{out}/data")
    constants = {c: v for c, v in made.constants.items() if v is not None}
    written = {k: v for k, v in record.items() if k != "file_paths"} | {"file_path": out, "variable": made.variable, "grid_type": made.grid_type, "constants": constants}
    spark.createDataFrame([(json.dumps(written, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("append").text(manifest)
    if remove_sources:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in dict.fromkeys(record["file_paths"]):
            at = hadoop.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return written
