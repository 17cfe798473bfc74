"""Planning on the driver, one lazy DataFrame for all groups, results and their JSON."""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right
from dataclasses import asdict, dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import identity
from ..functions.calendar import UNIT_CADENCE, expected_timestamps
from ..model import Query
from ..operators import stats
from ..operators.spatial import coarsen_grid, intersect_windows, native_index
from ..sources.store import ProductStore
from .metadata import overlapping, overlapping_buckets
from .normalize import normalize_query

GROUP = ("dataset_variant_id", "variable", "grid_id", "time_unit")


@dataclass
class Coverage:
    """Expected times, and for each wanted bucket the time ranges that partitions hold, united."""

    stamps: list[datetime] = field(default_factory=list)
    held: dict[str, list[tuple[datetime, datetime]]] = field(default_factory=dict)

    @property
    def hits(self) -> int:
        """(Bucket, time) cells that some partition holds."""
        return sum(bisect_right(self.stamps, b) - bisect_left(self.stamps, a) for spans in self.held.values() for a, b in spans)

    @property
    def misses(self) -> int:
        return len(self.stamps) * len(self.held) - self.hits


def united(spans: list[tuple[datetime, datetime]]) -> list[tuple[datetime, datetime]]:
    """Closed time ranges, in order and without overlaps."""
    out: list[tuple[datetime, datetime]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


@dataclass
class Plan:
    query: Query
    matched: list[Row]
    windows: dict[tuple, tuple[int, int, int, int]]
    coverage: dict[tuple, Coverage]
    warnings: list[str]


@dataclass
class Result:
    """``data`` has the group columns, the function's columns and ``value``; ``groups`` tells each group's provenance."""

    query: Query
    data: DataFrame | None
    groups: list[dict[str, Any]]
    warnings: list[str]


class Engine:
    """Answers queries from a product store."""

    def __init__(self, store: ProductStore, settings: Settings) -> None:
        self.store, self.settings = store, settings

    # --- planning

    def plan(self, raw: dict[str, Any] | Query) -> Plan:
        """Prune the index, cut windows and check coverage; no data is read.

        Index rows meet the wanted buckets' windows in Spark; the driver gets the non-empty meetings. Coverage is counted
        by time ranges, so its cost follows the partitions, not the length of the query.
        """
        query = raw if isinstance(raw, Query) else normalize_query(raw, self.settings)
        index = self.store.catalog("product_index").filter((F.col("variable") == query.of.variable) & (F.col("time_unit") == query.product.unit) & (F.col("coarseness_factor") == query.product.factor))
        names = self.store.catalog("datasets")
        for column, value in query.of.names().items():
            names = names.filter(F.col(column) == value)
        index = index.filter(overlapping(*query.when)).join(names, "dataset_variant_id")
        wanted = {r["bucket_id"] for r in overlapping_buckets(self.store.buckets.table(self.store.spark), query.region).collect()}
        tiles = self.store.catalog("bucket_windows").filter(F.col("bucket_id").isin(sorted(wanted)))
        order = ("repository", "dataset", "period", "time_start", "time_end", "partition_id")
        cuts = intersect_windows(index, tiles, "grid_id").orderBy(*order, "code").collect()
        matched, windows, held = {}, {}, {}
        for r in cuts:
            if not query.of.fits(json.loads(r["additional_parameters"])):
                continue
            key = tuple(r[c] for c in GROUP)
            cut = (r["y_start"], r["y_stop"], r["x_start"], r["x_stop"])
            windows[key] = tuple(f(a, b) for f, a, b in zip((min, max, min, max), windows.get(key, cut), cut, strict=True))
            held.setdefault(key, []).append(r)
            matched.setdefault(r["partition_id"], r)
        warnings, coverage = [], {}
        if not matched:
            warnings.append("No matching product partitions exist at the exact requested grid.")
        for key, parts in held.items():
            natives = {r["native"] for r in parts}
            cadence = UNIT_CADENCE.get(query.product.unit) or (next(iter(natives)) if len(natives) == 1 else None)
            if cadence is None:
                warnings.append(f"Cannot check source coverage for {key[0]}.")
                continue
            spans = {b: united([(r["time_start"], r["time_end"]) for r in parts if r["bucket_id"] == b]) for b in wanted}
            own = coverage[key] = Coverage(expected_timestamps(*query.when, cadence), spans)
            if own.misses:
                warnings.append(f"{key[0]} is missing {own.misses} of {own.misses + own.hits} bucket/time cells.")
        return Plan(query, list(matched.values()), windows, coverage, warnings)

    def estimate(self, plan: Plan) -> dict[str, int]:
        """Cells, intervals, blocks, values and groups that a plan would touch, from metadata."""
        f = plan.query.product.factor
        cells = sum(math.ceil((y1 - y0) / f) * math.ceil((x1 - x0) / f) for y0, y1, x0, x1 in plan.windows.values())
        steps = max([1, *(len(own.stamps) for own in plan.coverage.values())])
        return {"cells": cells, "intervals": steps, "blocks": len(plan.matched), "values": cells * steps, "groups": len(plan.windows)}

    def enforce_limits(self, plan: Plan) -> dict[str, int]:
        most, found = self.settings.limits, self.estimate(plan)
        for name in ("cells", "blocks", "values", "groups"):
            if found[name] > getattr(most, name):
                raise ValueError(f"Estimated {found[name]} {name} exceed the limit of {getattr(most, name)}")
        self._enforce_days(plan.query)
        return found

    def _enforce_days(self, query: Query) -> None:
        if query.days > self.settings.limits.days:
            raise ValueError(f"The time span exceeds the limit of {self.settings.limits.days} days")

    # --- execution

    def _statistics(self, plan: Plan) -> DataFrame:
        """Statistics of all groups' cells with their geometry, native indices and the region's mask applied."""
        q, factor = plan.query, plan.query.product.factor
        grids = None
        for key in sorted({k[2] for k in plan.windows}):
            # a block at the window's edge is coarsened from all of its cells
            y0, y1, x0, x1 = self._blocks(plan, factor, key)
            cells = self.store.grid(key).filter(F.col("gy").between(y0 * factor, y1 * factor + factor - 1) & F.col("gx").between(x0 * factor, x1 * factor + factor - 1))
            if factor > 1:
                cells = coarsen_grid(cells, factor)
            cells = cells.select("gy", "gx", "lat", "lon", "cell_area").withColumn("grid_id", F.lit(key)).filter(stats.region_mask(q.region))
            grids = cells if grids is None else grids.unionByName(cells)
        data = self.store.read_products(plan.matched, *q.when)
        y0, y1, x0, x1 = self._blocks(plan, factor)
        data = data.filter(F.col("gy").between(y0, y1) & F.col("gx").between(x0, x1))
        joined = data.join(grids, ["grid_id", "gy", "gx"])
        if q.product.unit == "Source":
            joined = stats.expand(joined)
        return joined.withColumns({"gy": native_index("gy", factor), "gx": native_index("gx", factor)})

    def _blocks(self, plan: Plan, factor: int, grid: str | None = None) -> tuple[int, int, int, int]:
        """First and last block, by row and column, of the windows of a grid, or of all."""
        own = [w for k, w in plan.windows.items() if grid in (None, k[2])]
        y0, y1, x0, x1 = (f(w[i] for w in own) for i, f in enumerate((min, max, min, max)))
        return y0 // factor, (y1 - 1) // factor, x0 // factor, (x1 - 1) // factor

    def execute(self, raw: dict[str, Any] | Query, limits: bool = False, only_matches: bool = False) -> Result:
        q = raw if isinstance(raw, Query) else normalize_query(raw, self.settings)
        if limits:
            self._enforce_days(q)
        plan = self.plan(q)
        if limits:
            self.enforce_limits(plan)
        what = q.operation
        if not plan.matched:
            return Result(q, None, [], plan.warnings)
        cells = self._statistics(plan)
        if what.function == "get-data":
            data = stats.get_data(cells, what.aggregation, *GROUP, "ts", "gy", "gx", "lat", "lon")
        elif what.function in ("timeseries", "find-time"):
            data = stats.timeseries(cells, what.aggregation, *GROUP)
        else:
            where = cells.groupBy(*GROUP, "gy", "gx").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"))
            data = stats.heatmap(cells, what.aggregation, *GROUP).join(where, [*GROUP, "gy", "gx"])
        if what.test:
            data = stats.find(data, what.test.predicate, what.test.value, only_matches)
        return Result(q, data, [self._provenance(plan, key) for key in plan.windows], plan.warnings)

    def _provenance(self, plan: Plan, key: tuple) -> dict[str, Any]:
        rows = [r for r in plan.matched if tuple(r[c] for c in GROUP) == key]
        first, own = rows[0], plan.coverage.get(key, Coverage())
        variables = json.loads(first["variables"]).get(key[1], {})
        return dict(zip(GROUP, key, strict=True)) | {
            "group_id": identity.stable_id({"variant": key[0], "variable": key[1], "grid": key[2]}), "query_id": query_id(plan.query),
            "repository": first["repository"], "dataset": first["dataset"], "additional_parameters": json.loads(first["additional_parameters"]), "units": variables.get("units"),
            "window": plan.windows[key], "coarseness_factor": plan.query.product.factor, "function": plan.query.operation.function, "aggregation": plan.query.operation.aggregation,
            "partitions": [r["partition_id"] for r in rows], "hits": own.hits, "misses": own.misses,
        }

    def write_result(self, result: Result, path: str) -> str:
        """Parquet of all groups under the query's id, and a manifest beside it."""
        out = f"{path}/{query_id(result.query)}/{result.query.operation.function}"
        if result.data is not None:
            result.data.write.mode("overwrite").partitionBy("dataset_variant_id", "grid_id").parquet(out)
        lines = [json.dumps({"groups": result.groups, "warnings": result.warnings}, default=str)]
        self.store.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{out}_manifest")
        return out


def query_id(query: Query) -> str:
    return identity.stable_id({k: str(v) for k, v in asdict(query).items()})


def finite(x: Any) -> Any:
    return None if isinstance(x, float) and not math.isfinite(x) else x


def serialize(result: Result) -> dict[str, Any]:
    """Plot JSON of a result within the limits: every group's payload and the warnings."""
    rows = result.data.collect() if result.data is not None else []  # admission control bounds a served result
    groups = []
    for g in result.groups:
        own = [r for r in rows if all(r[c] == g[c] for c in GROUP)]
        if not any(r["value"] is not None for r in own):
            result.warnings.append(f"No data of {g['dataset']} remains in the requested region.")
        groups.append({"group_id": g["group_id"], "repository": g["repository"], "dataset": g["dataset"], "variable": g["variable"], "grid_id": g["grid_id"], "additional_parameters": g["additional_parameters"], "units": g["units"], "coarseness_factor": g["coarseness_factor"], "data": _payload(result.query, own)})
    return {"query_id": query_id(result.query), "groups": groups, "warnings": result.warnings}


def _payload(q: Query, rows: list[Row]) -> dict[str, Any]:
    what = q.operation
    stamp = lambda r: r["ts"].isoformat(timespec="seconds")
    if what.function == "get-data":
        return {"kind": what.function, "timestamps": sorted({stamp(r) for r in rows}), "grid_shape": [len({r["gy"] for r in rows}), len({r["gx"] for r in rows})]}
    out: dict[str, Any] = {"kind": what.function}
    if what.function in ("timeseries", "find-time"):
        rows = sorted(rows, key=lambda r: r["ts"])
        out |= {"timestamps": [stamp(r) for r in rows], "values": [finite(r["value"]) for r in rows]}
        if what.test:
            out["matches"] = [r["matches"] for r in rows]
    else:
        ys, xs, at = sorted({r["gy"] for r in rows}), sorted({r["gx"] for r in rows}), {(r["gy"], r["gx"]): r for r in rows}
        table = lambda f: [[f(at[y, x]) if (y, x) in at else None for x in xs] for y in ys]
        out |= {"grid_y_indices": ys, "grid_x_indices": xs, "latitudes": table(lambda r: finite(r["lat"])), "longitudes": table(lambda r: (r["lon"] + 180) % 360 - 180), "values": table(lambda r: finite(r["value"]))}
        if what.test:
            out["matches"] = table(lambda r: r["matches"])
    return out | ({"predicate": what.test.predicate, "filter_value": what.test.value} if what.test else {})
