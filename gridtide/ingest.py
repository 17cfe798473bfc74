"""Ingestion: standardize, build the pyramid, blend sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Settings
from .functions.calendar import UNIT_CADENCE, infer_cadence
from .operators import combine, stats
from .operators.spatial import is_periodic, spatial_product
from .operators.temporal import product_policy, temporal_product
from .sources.standardize import standardize
from .sources.store import ProductStore


@dataclass(frozen=True)
class Source:
    """One standardized variable of a dataset variant."""

    repository: str
    dataset: str
    variable: str
    units: str
    data: DataFrame  # ts, gy, gx, value (and source_count)
    grid: DataFrame
    grid_type: str = "rectilinear"
    parameters: dict[str, str] | None = None
    native: str | None = None


def from_table(table: DataFrame, repository: str, dataset: str, variable: str, units: str, settings: Settings, parameters: dict[str, str] | None = None) -> Source:
    """Standardize a provider's table by the configured names."""
    own = standardize(table, variable, settings.repositories[repository][dataset]["variables"])
    return Source(repository, dataset, own.variable, units, own.data, own.grid, own.grid_type, parameters)


def ingest(store: ProductStore, source: Source, settings: Settings, combined: bool = False) -> dict[tuple[str, int], int]:
    """Write all products of a source; (time unit, factor) -> new partitions.

    Means and extremes of a product come from the statistics of the finer one before it, read back from the store: a period is
    complete just when the finer product has all its labels. Other reducers go back to the samples. Both coarseness factors
    share the temporal product.
    """
    native = source.native or infer_cadence(source.data.select("ts").distinct())
    products = product_policy(native, combined)
    grid = store.ensure_grid(source.grid, source.grid_type)
    variant = store.upsert_dataset(source.repository, source.dataset, {source.variable: {"units": source.units, "source_temporal_resolution": native}}, source.parameters)
    counts = ("source_count",) if "source_count" in source.data.columns else ()
    cells = stats.expand(source.data.join(source.grid.select("gy", "gx", "cell_area"), ["gy", "gx"]))
    method = settings.reducer(source.variable)
    finer, cadence, out = cells, native, {}
    for unit in dict.fromkeys(u for u, _ in products):
        if unit == "Source":
            out[unit, 1] = store.write_product(source.data, variant, source.variable, grid, unit, 1, native)
            continue
        product = temporal_product(finer, cadence, UNIT_CADENCE[unit], "gy", "gx", method=method, maxima=counts)
        for factor in [f for u, f in products if u == unit]:
            if factor > 1:
                written = store.stored(variant, source.variable, grid, unit, 1)
                product = written.select("ts", "gy", "gx", *stats.STATISTICS, *counts) if written is not None else product.limit(0)
            out[unit, factor] = store.write_product(spatial_product(product, factor, "ts", maxima=counts), variant, source.variable, grid, unit, factor, native)
        if method == "mean":
            written = store.stored(variant, source.variable, grid, unit, 1)
            finer = written.select("ts", "gy", "gx", *stats.STATISTICS, *counts) if written is not None else product.limit(0)
            cadence = UNIT_CADENCE[unit]
    return out


def _axes(cells: DataFrame) -> tuple[list[float], list[float]]:
    """Latitudes and longitudes of a rectilinear grid, as many numbers as it has rows and columns."""
    return tuple([r["c"] for r in cells.groupBy(i).agg(F.min(c).alias("c")).orderBy(i).collect()] for i, c in (("gy", "lat"), ("gx", "lon")))


def weights_for(source: Source, target: Source) -> DataFrame | None:
    """The regrid table of a source, None where it lies on the target's grid already.

    Projected grids need their projection, which a ``Source`` doesn't hold: make their table with
    ``combine.projected_weights``.
    """
    if source.grid_type == target.grid_type == "rectilinear" and _axes(source.grid) == _axes(target.grid):
        return None
    if source.grid_type != "rectilinear":
        raise ValueError(f"{source.repository}/{source.dataset} is on a {source.grid_type} grid: give its regrid weights")
    lats, lons = (source.grid.select(i, c).distinct() for i, c in (("gy", "lat"), ("gx", "lon")))
    around = "lon_lo" in source.grid.columns and is_periodic(source.grid).first()["periodic"]
    return combine.bilinear_weights(lats, lons, target.grid.select("gy", "gx", "lat", "lon"), periodic=bool(around))


def blend(sources: list[Source], target: Source, settings: Settings, weights: dict[str, DataFrame]) -> Source:
    """The combined dataset: daily means with coverage, regridded to ``target``'s grid, averaged by weight.

    ``weights`` holds the regrid tables of sources (``repository/dataset``), for instance stored ones. For any other source
    on another grid than the target's one is made, or an error raised where that can't be done.
    """
    own = settings.combined
    if target.grid_type != "rectilinear":
        raise ValueError("the target grid must be rectilinear")
    units = {s.units for s in sources}
    if len(units) != 1:
        raise ValueError(f"{target.variable} has incompatible units: {', '.join(sorted(units))}")
    parts = None
    for s in sources:
        name, native = f"{s.repository}/{s.dataset}", s.native or infer_cadence(s.data.select("ts").distinct())
        day = combine.daily_mean_with_coverage(s.data, combine.required_samples(native, own.minimum_daily_coverage), "gy", "gx")
        table = weights[name] if name in weights else weights_for(s, target)
        if table is not None:
            day = combine.apply_weights(day, table, "ts")
        day = day.select("ts", "gy", "gx", "value", F.lit(float(own.weights.get(name, own.default_weight))).alias("weight"))
        parts = day if parts is None else parts.unionByName(day)
    data = combine.weighted_mean(parts, "ts", "gy", "gx", weight=F.col("weight"))
    return Source(own.repository, own.dataset, target.variable, units.pop(), data, target.grid, "rectilinear", None, "1D")
