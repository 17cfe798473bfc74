"""The product store: Parquet products with their catalogs.

A write goes to a folder of its own, a partition of the store, which is Hive-partitioned by product and storage
period below; its index rows are added last. Only indexed folders are read, so a
failed write leaves nothing visible, and a repeated one adds nothing.
Catalogs hold a row per dataset, grid, bucket window or partition, and are
read and planned with on the driver.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.geo import BucketGrid
from ..operators.spatial import extent
from ..operators.stats import STATISTICS
from ..operators.temporal import drop_repeated_timestamps

PRODUCT_KEYS = ("dataset_variant_id", "variable", "time_unit", "coarseness_factor", "period")
SCHEMAS = {
    "datasets": "dataset_variant_id string, repository string, dataset string, additional_parameters string, variables string, display_name string",
    "grids": "grid_id string, grid_type string, shape_y int, shape_x int, relative_path string",
    "bucket_windows": "grid_id string, code int, bucket_id string, y_start int, y_stop int, x_start int, x_stop int",
    "product_index": "partition_id string, dataset_variant_id string, variable string, grid_id string, time_unit string, coarseness_factor int, period string,"
    " time_start timestamp_ntz, time_end timestamp_ntz, y_start int, y_stop int, x_start int, x_stop int, native string, relative_path string",
}


def _doubled(entries: list[Row]) -> set[str]:
    """Ids of index entries that share times and cells with another one of their product; entries are in order of time."""
    found, open_ = set(), {}
    for r in entries:
        own = open_.setdefault((r["dataset_variant_id"], r["variable"], r["grid_id"], r["time_unit"], r["coarseness_factor"]), [])
        own[:] = [x for x in own if x["time_end"] >= r["time_start"]]
        for x in own:
            if x["y_start"] < r["y_stop"] and r["y_start"] < x["y_stop"] and x["x_start"] < r["x_stop"] and r["x_start"] < x["x_stop"]:
                found |= {x["partition_id"], r["partition_id"]}
        own.append(r)
    return found


@dataclass
class ProductStore:
    """A store below ``root``, any folder that Spark reads and writes."""

    spark: SparkSession
    root: str
    buckets: BucketGrid = BucketGrid()

    # --- catalogs

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def catalog(self, name: str) -> DataFrame:
        """A catalog; empty where it doesn't exist yet."""
        path = f"{self.root}/catalogs/{name}"
        return self.spark.read.schema(SCHEMAS[name]).parquet(path) if self._exists(path) else self.spark.createDataFrame([], SCHEMAS[name])

    def _append(self, name: str, rows: list[tuple], key: str) -> int:
        """Insert rows whose ``key`` isn't there yet."""
        new = self.spark.createDataFrame(rows, SCHEMAS[name]).join(self.catalog(name).select(key).distinct(), key, "left_anti").select([x.split()[0] for x in SCHEMAS[name].split(", ") if x])
        kept = new.collect()  # catalog rows
        if kept:
            self.spark.createDataFrame(kept, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{self.root}/catalogs/{name}")
        return len(kept)

    def upsert_dataset(self, repository: str, dataset: str, variables: dict[str, dict], parameters: dict[str, str] | None = None, display_name: str = "") -> str:
        """Add a dataset variant, or its new variables; what a variable has now wins."""
        key = identity.variant_id(repository, dataset, parameters)
        rows = {r["dataset_variant_id"]: r.asDict() for r in self.catalog("datasets").collect()}
        old = rows.get(key)
        if old and (old["repository"], old["dataset"]) != (repository, dataset):
            raise ValueError(f"dataset variant {key} belongs to {old['repository']}/{old['dataset']}")
        merged = {**(json.loads(old["variables"]) if old else {}), **variables}
        made = dict(dataset_variant_id=key, repository=repository, dataset=dataset, additional_parameters=json.dumps(parameters or {}, sort_keys=True), variables=json.dumps(merged, sort_keys=True), display_name=display_name or (old or {}).get("display_name") or dataset)
        if made != old:
            rows[key] = made
            names = [x.split()[0] for x in SCHEMAS["datasets"].split(", ")]
            self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows.values()], SCHEMAS["datasets"]).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/catalogs/datasets")
        return key

    def ensure_grid(self, cells: DataFrame, grid_type: str, crs: dict | None = None) -> str:
        """Write a grid and its bucket windows once; the id follows from its geometry."""
        if grid_type not in ("rectilinear", "projected"):
            raise ValueError(f"{grid_type} grids can't be canonical")
        axes = cells.agg(F.array_sort(F.collect_set("gy")).alias("y"), F.array_sort(F.collect_set("gx")).alias("x")).first()
        lat = [r["lat"] for r in cells.groupBy("gy").agg(F.min("lat").alias("lat")).orderBy("gy").collect()]
        lon = [r["lon"] for r in cells.groupBy("gx").agg(F.min("lon").alias("lon")).orderBy("gx").collect()]
        key = identity.grid_id(grid_type, lat, lon, crs)
        path = f"grids/{key}"
        if not self._exists(f"{self.root}/{path}"):
            cells.write.parquet(f"{self.root}/{path}")
        self._append("grids", [(key, grid_type, len(axes["y"]), len(axes["x"]), path)], "grid_id")
        if self.catalog("bucket_windows").filter(F.col("grid_id") == key).isEmpty():
            found = extent(cells.withColumn("code", self.buckets.code("lat", "lon")), "code").withColumn("bucket_id", self.buckets.bucket_id(F.col("code")))
            rows = [(key, r["code"], r["bucket_id"], r["y_start"], r["y_stop"], r["x_start"], r["x_stop"]) for r in found.collect()]
            self.spark.createDataFrame(rows, SCHEMAS["bucket_windows"]).coalesce(1).write.mode("append").parquet(f"{self.root}/catalogs/bucket_windows")
        return key

    def grid(self, key: str) -> DataFrame:
        if not self._exists(f"{self.root}/grids/{key}"):
            raise FileNotFoundError(f"no grid {key}")
        return self.spark.read.parquet(f"{self.root}/grids/{key}")

    def migrate_grid_ids(self) -> dict[str, str]:
        """Recompute all grids' ids, unite equal ones and rename them in the index; old id -> new id.

        Two grids that get the same id must have the same cells. Grid folders
        of old ids stay; the old catalogs are kept beside the new ones.
        """
        moved: dict[str, str] = {}
        rows: dict[str, tuple] = {}
        for r in self.catalog("grids").collect():
            cells = self.spark.read.parquet(f"{self.root}/{r['relative_path']}")
            lat = [x["lat"] for x in cells.groupBy("gy").agg(F.min("lat").alias("lat")).orderBy("gy").collect()]
            lon = [x["lon"] for x in cells.groupBy("gx").agg(F.min("lon").alias("lon")).orderBy("gx").collect()]
            key = identity.grid_id(r["grid_type"], lat, lon)
            if key in rows:
                other = self.spark.read.parquet(f"{self.root}/{rows[key][4]}")
                if not cells.select("gy", "gx", "lat", "lon").exceptAll(other.select("gy", "gx", "lat", "lon")).isEmpty():
                    raise ValueError(f"grids {r['grid_id']} and {rows[key][0]} collide")
            else:
                if not self._exists(f"{self.root}/grids/{key}"):
                    cells.write.parquet(f"{self.root}/grids/{key}")
                rows[key] = (key, r["grid_type"], r["shape_y"], r["shape_x"], f"grids/{key}")
            moved[r["grid_id"]] = key
        if all(a == b for a, b in moved.items()):
            return moved
        names = F.create_map(*(F.lit(x) for pair in moved.items() for x in pair))
        for name in ("product_index", "bucket_windows"):
            new = self.catalog(name).withColumn("grid_id", F.coalesce(names[F.col("grid_id")], F.col("grid_id"))).distinct().collect()
            self._replace(name, new)
        self._replace("grids", list(rows.values()))
        return moved

    def _replace(self, name: str, rows: list) -> None:
        """A new catalog in place of the old one, which is kept as ``<name>-old``."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = f"{self.root}/catalogs/{name}"
        self.spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.mode("overwrite").parquet(f"{at}-new")
        fs = hadoop.Path(at).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(hadoop.Path(f"{at}-old"), True)
        fs.rename(hadoop.Path(at), hadoop.Path(f"{at}-old"))
        fs.rename(hadoop.Path(f"{at}-new"), hadoop.Path(at))

    # --- products

    def product_paths(self) -> list[str]:
        """Distinct paths that the index names, ordered by time and path; a path that leaves the store is an error."""
        rows = self.catalog("product_index").groupBy("relative_path").agg(F.min("time_start").alias("t")).orderBy("t", "relative_path").collect()
        for r in rows:
            if posixpath.isabs(r["relative_path"]) or posixpath.normpath(r["relative_path"]).split("/")[0] == "..":
                raise ValueError(f"the product path {r['relative_path']!r} leaves the store")
        return [f"{self.root}/{posixpath.normpath(r['relative_path'])}" for r in rows]

    def write_product(self, data: DataFrame, variant: str, variable: str, grid: str, time_unit: str, factor: int, native: str) -> int:
        """Write the storage periods of a product that aren't indexed yet; how many there were.

        ``data``: ``ts, gy, gx`` and ``value`` for Source, the statistics (and ``source_count``)
        for others. Months are periods of Source, Hour and Day, years of Month and Year.
        """
        period = F.date_format("ts", "yyyy-MM" if time_unit in ("Source", "Hour", "Day") else "yyyy")
        columns = ["value"] if time_unit == "Source" else [*STATISTICS, *(["source_count"] if "source_count" in data.columns else [])]
        data = data.select("ts", "gy", "gx", *columns, period.alias("period"))
        made = data.groupBy("period").agg(
            F.min("ts").alias("time_start"), F.max("ts").alias("time_end"), F.min("gy").alias("y_start"), (F.max("gy") + 1).alias("y_stop"), F.min("gx").alias("x_start"), (F.max("gx") + 1).alias("x_stop"),
        )
        ids = {r["period"]: (identity.partition_id(variant, variable, grid, time_unit, factor, str(r["time_start"]), str(r["time_end"])), r) for r in made.collect()}
        indexed = self.catalog("product_index").filter((F.col("dataset_variant_id") == variant) & (F.col("variable") == variable)).select("partition_id", "relative_path").collect()
        for r in indexed:
            if not self._exists(f"{self.root}/{r['relative_path']}"):
                raise FileNotFoundError(f"Index points to missing partition {r['relative_path']}")
        there = {r["partition_id"] for r in indexed}
        new = {p: x for p, x in ids.items() if x[0] not in there}
        if not new:
            return 0
        path = f"products/write={uuid.uuid4().hex}"
        keyed = data.filter(F.col("period").isin(list(new))).withColumns({"dataset_variant_id": F.lit(variant), "variable": F.lit(variable), "time_unit": F.lit(time_unit), "coarseness_factor": F.lit(factor)})
        # files of a period are dealt by range of time and place, and sorted, so that row groups can be skipped
        keyed.repartitionByRange("period", "ts", "gy", "gx").sortWithinPartitions("period", "ts", "gy", "gx").write.partitionBy(*PRODUCT_KEYS).parquet(f"{self.root}/{path}")
        rows = [(key, variant, variable, grid, time_unit, factor, p, r["time_start"], r["time_end"], r["y_start"] * factor, r["y_stop"] * factor, r["x_start"] * factor, r["x_stop"] * factor, native, path) for p, (key, r) in new.items()]
        return self._append("product_index", rows, "partition_id")

    def read_products(self, matched: list[Row], start: datetime, end: datetime) -> DataFrame:
        """All rows of matched index entries as one DataFrame, with their product keys; pruned by partition, time and column.

        All folders are one scan. Where entries of a product overlap in time and place, as when a
        period is written again with more days, the first of them (by range, then id) has a cell and time.
        """
        unit = matched[0]["time_unit"]
        values = "value double" if unit == "Source" else ", ".join([*(f"{c} double" for c in STATISTICS), "source_count smallint"])
        schema = f"ts timestamp_ntz, gy int, gx int, {values}, dataset_variant_id string, variable string, time_unit string, coarseness_factor int, period string, write string"
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/products").parquet(*sorted({f"{self.root}/{r['relative_path']}" for r in matched}))
        for key in PRODUCT_KEYS:
            rows = rows.filter(F.col(key).isin(sorted({r[key] for r in matched})))
        rows = rows.filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
        order = ("time_start", "time_end", "partition_id")
        ranked = sorted(matched, key=lambda r: tuple(r[c] for c in order))
        doubled = _doubled(ranked)
        entry = [(r["relative_path"].split("=")[-1], *(r[c] for c in ("dataset_variant_id", "period", "grid_id")), k, r["partition_id"] in doubled) for k, r in enumerate(ranked)]
        entries = self.spark.createDataFrame(entry, "write string, dataset_variant_id string, period string, grid_id string, place int, doubled boolean")
        keys = ["write", "dataset_variant_id", "period"]
        rows = rows.join(entries, keys).drop("write")
        if not doubled:
            return rows.drop("place", "doubled")
        once = drop_repeated_timestamps(rows.filter("doubled"), "dataset_variant_id", "variable", "grid_id", "ts", "gy", "gx", order="place")
        return rows.filter("NOT doubled").unionByName(once).drop("place", "doubled")

    def stored(self, variant: str, variable: str, grid: str, time_unit: str, factor: int) -> DataFrame | None:
        """All rows of one product; None where there are none."""
        index = self.catalog("product_index").filter((F.col("dataset_variant_id") == variant) & (F.col("variable") == variable) & (F.col("grid_id") == grid))
        found = index.filter((F.col("time_unit") == time_unit) & (F.col("coarseness_factor") == factor)).collect()
        return self.read_products(found, min(r["time_start"] for r in found), max(r["time_end"] for r in found)) if found else None

    def compact(self, path: str) -> None:
        """Rewrite one write's folder with the current layout: to a new folder, checked, then swapped in."""
        full, fresh = f"{self.root}/{path}", f"{self.root}/{path}-compacted"
        old = self.spark.read.option("basePath", full).parquet(full)
        old.repartitionByRange("period", "ts", "gy", "gx").sortWithinPartitions("period", "ts", "gy", "gx").write.partitionBy(*PRODUCT_KEYS).parquet(fresh)
        new = self.spark.read.option("basePath", fresh).parquet(fresh)
        if new.columns != old.columns or new.count() != old.count():
            raise ValueError(f"compaction of {path} changed its rows")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(full).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.rename(hadoop.Path(full), hadoop.Path(f"{full}-old"))
        fs.rename(hadoop.Path(fresh), hadoop.Path(full))
        fs.delete(hadoop.Path(f"{full}-old"), True)
