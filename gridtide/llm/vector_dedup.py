"""Near-duplicate vectors by Euclidean p-stable hashing.

Unit vectors are projected on random directions; the projections, shifted and
divided by a width, are floored, and a few of them make a bucket of a table.
Vectors that share a bucket in some table are compared by exact cosine. Large
buckets are cut into blocks, and a task compares two blocks by one matrix
product; it returns link counts and a spanning forest, never the pairs. A pair
counts in the first table that brings it together only.

This is done twice. At first rows carry a sketch of a byte a part, which
tells with certainty who has no partner in a bucket; then only those that may
have one meet with their whole vectors. Keys of other tables are not
carried but worked out again from the vectors of the pairs found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, pieces, runtime
from .components import connected_components

#: Quantisation width for unit vectors.
WIDTH = 1.5
#: Chance to miss a pair just at the threshold; unrelated vectors that a bucket may hold on average.
MISS, STRANGERS = 0.003, 32


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one floored projection is equal for two vectors at a Euclidean distance."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(n: int, cosine: float) -> tuple[int, int]:
    """Projections per table and tables, for ``n`` vectors that may be compared with each other."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    projections = max(2, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(far)))
    return projections, max(1, math.ceil(math.log(MISS) / math.log1p(-(near**projections))))


#: Steps of a unit vector's parts and of the directions' parts, as they are projected. Sums of their products are whole
#: numbers below 2**53, so a bucket is the same on every machine, in whatever order it is summed.
VECTOR_STEPS, DIRECTION_STEPS = 1 << 15, 1 << 12


def _directions(dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` directions and shifts, in whole steps."""
    draw = np.random.Generator(np.random.Philox([31, dim]))
    across = np.rint(draw.standard_normal((n, dim)) * DIRECTION_STEPS)
    return across, np.floor(draw.uniform(0, WIDTH, n) * (VECTOR_STEPS * DIRECTION_STEPS))


class _Buckets:
    """The buckets of unit vectors in a number of tables."""

    def __init__(self, projections: int, tables: int) -> None:
        self.projections, self.tables = projections, tables
        self._known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._step = np.random.Generator(np.random.Philox(32)).integers(1, 1 << 63, (tables, projections + 2), dtype=np.uint64) | np.uint64(1)

    def of(self, unit: np.ndarray, label: int, tables: int | None = None) -> np.ndarray:
        """The vector's bucket in each of the first ``tables`` tables; ``label`` is a hash of its label."""
        n = self.tables if tables is None else tables
        if len(unit) not in self._known:
            self._known[len(unit)] = _directions(len(unit), self.projections * self.tables)
        across, shift = (x[: n * self.projections] for x in self._known[len(unit)])
        cells = np.floor((across @ np.rint(unit * VECTOR_STEPS) + shift) / (WIDTH * VECTOR_STEPS * DIRECTION_STEPS))
        cells = cells.astype(np.int64).view(np.uint64).reshape(n, self.projections)
        step = self._step[:n]
        own = (cells * step[:, : self.projections]).sum(1) + step[:, self.projections] * np.uint64(len(unit))
        own += step[:, self.projections + 1] * np.uint64(label & ((1 << 64) - 1))
        return ((own ^ (own >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def sketch(unit: np.ndarray) -> tuple[bytes, float, float]:
    """The unit vector in a byte a part, the size of a step, and the length of what rounding left out."""
    step = float(np.abs(unit).max()) / 127
    whole = np.rint(unit / step).astype(np.int8)
    return whole.tobytes(), step, float(np.linalg.norm(unit - whole * step))


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; None for null, empty, zero and those with null or non-finite parts."""
    out: list[np.ndarray | None] = []
    values, offsets = column.values, column.offsets.to_numpy()
    numbers, null = np.asarray(values.cast(pa.float64()).to_numpy(zero_copy_only=False)), np.asarray(values.is_null())
    for k, ok in enumerate(column.is_valid().to_pylist()):
        v = numbers[offsets[k] : offsets[k + 1]]
        ok = ok and len(v) and not null[offsets[k] : offsets[k + 1]].any() and np.isfinite(v).all() and v.any()
        out.append(v if ok else None)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()  # no overflow or underflow in the norm
    return v / np.linalg.norm(v)


def _vectors(rows: DataFrame) -> DataFrame:
    """``id, label, vec`` (bytes of doubles) and ``vhash``; both null where a vector can't be linked."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if v is None else v.tobytes() for v in _rows(batch.column(2))]
            hashes = [None if x is None else xxhash.xxh3_128_digest(x) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), pa.array(hashes, pa.binary())], names=["id", "label", "vec", "vhash"])

    kinds = [f.dataType.simpleString() for f in rows.schema]
    return rows.mapInArrow(pieces.tidy(run), f"id {kinds[0]}, label {kinds[1]}, vec binary, vhash binary")


def _posted(classes: DataFrame, projections: int, tables: int) -> DataFrame:
    """``rep, n_dims, label, sketch, step, lost, keys``: a vector's sketch, and its bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(projections, tables)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # a bounded number of keys at a time
                part = batch.slice(a, 256)
                units = [_unit(np.frombuffer(v)) for v in part.column(2).to_pylist()]
                keys = [buckets.of(u, label) for u, label in zip(units, part.column(1).to_pylist(), strict=True)]
                made, step, lost = zip(*map(sketch, units), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(u) for u in units], pa.int32()), part.column(1), pa.array(made, pa.binary()), pa.array(step, pa.float64()), pa.array(lost, pa.float64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * tables, pa.int32()), pa.array(np.concatenate(keys))),
                    ],
                    names=["rep", "n_dims", "label", "sketch", "step", "lost", "keys"],
                )

    rows = classes.select("rep", F.xxhash64("label").alias("label"), "vec")
    return rows.mapInArrow(pieces.tidy(run), f"rep {rows.schema[0].dataType.simpleString()}, n_dims int, label long, sketch binary, step double, lost double, keys array<bigint>")


def _alike(unit: pa.Table) -> list[np.ndarray]:
    """Rows of the unit by length of their vectors and label: only these are compared with each other."""
    kind = np.stack([unit.column("n_dims").to_numpy(), unit.column("label").to_numpy()])
    if (kind == kind[:, :1]).all():  # as good as always
        return [np.arange(unit.num_rows)]
    _, own = np.unique(kind, axis=1, return_inverse=True)
    return [np.flatnonzero(own == k) for k in range(own.max() + 1)]


def _near(unit: pa.Table, vectors: np.ndarray, rows: np.ndarray, least: np.ndarray | float, spare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``rows`` whose vectors' product is ``least`` (less what ``spare`` allows both), each pair of the unit once."""
    left, right, same = blocks.sides(unit)
    place = np.full(unit.num_rows, -1)
    place[rows] = np.arange(len(rows))
    left, right = left[place[left] >= 0], right[place[right] >= 0]
    product = vectors[place[left]] @ vectors[place[right]].T
    if spare is not None:
        product += spare[left][:, None] + spare[right]
    x, y = np.nonzero(product >= least)
    x, y = left[x], right[y]
    return (x[x < y], y[x < y]) if same else (x, y)


def _active(cosine: float):
    """``t, bucket, rep`` of the rows that may have a partner in a unit of block pairs, as far as sketches tell.

    The product of two sketches is off by at most what rounding left out of
    both vectors (their lengths are 1), so no partner is missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in blocks.units(batches, "t", "bucket"):
            lost = unit.column("lost").to_numpy()
            spare, found = lost * (1 + lost) + 1e-9, []
            for rows in _alike(unit):
                if len(rows) > 1:
                    whole = np.frombuffer(b"".join(unit.column("sketch").take(pa.array(rows)).to_pylist()), np.int8).reshape(len(rows), -1)
                    found += _near(unit, whole * unit.column("step").to_numpy()[rows][:, None], rows, cosine, spare)
            if found and len(own := np.unique(np.concatenate(found))):
                yield unit.select(["t", "bucket", "rep"]).take(pa.array(own)).combine_chunks().to_batches()[0]

    return run


def _compare(cosine: float, projections: int, tables: int):
    """Sorted rows of block pairs in; ``rep, links, other`` out: link counts, and a forest's links where not null.

    A pair counts in the first table that it shares.
    """

    def pairs(unit: pa.Table, buckets: _Buckets) -> pa.RecordBatch | None:
        t, labels = unit.column("t")[0].as_py(), unit.column("label").to_pylist()
        units = [_unit(np.frombuffer(x)) for x in unit.column("vec").to_pylist()]
        rep, n = (unit.column(c).to_numpy() for c in ("rep", "n"))
        found = [_near(unit, np.stack([units[k] for k in rows]), rows, cosine) for rows in _alike(unit) if len(rows) > 1]
        x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if t and len(x):
            own = np.unique(np.concatenate([x, y]))
            keys = np.stack([buckets.of(units[k], labels[k], t) for k in own])
            px, py, first = np.searchsorted(own, x), np.searchsorted(own, y), np.ones(len(x), bool)
            for k in range(0, len(x), 4096):
                first[k : k + 4096] = ~(keys[px[k : k + 4096]] == keys[py[k : k + 4096]]).any(1)
            x, y = x[first], y[first]
        if not len(x):
            return None
        links = np.bincount(x, n[y], len(rep)) + np.bincount(y, n[x], len(rep))
        has = np.flatnonzero(links)
        other = rep[blocks.forest(x, y, len(rep))[has]]
        return pa.RecordBatch.from_arrays([pa.array(rep[has]), pa.array(links[has].astype(np.int64)), pa.array(other)], names=["rep", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(projections, tables)
        for unit in blocks.units(batches, "t", "bucket"):
            if (found := pairs(unit, buckets)) is not None:
                yield found

    return run


def near_vectors(
    rows: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", block: int = blocks.BLOCK,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors are linked when their labels are equal and not null (all labels
    count as equal without ``label_col``) and their cosine, in double precision,
    is at least ``cosine``. No reported link is below it. A pair just at
    the threshold is missed with a chance of ``MISS``, a closer one with less;
    equal vectors are never missed. Tables and projections follow the number of
    distinct vectors of the largest label, so buckets stay small at any size.

    Vectors that are null, empty or zero, or that hold null or non-finite parts,
    are linked with nothing, as are rows with a null id (whose component is null;
    they are kept). Vectors of different lengths aren't linked. Rows that repeat
    an id count as separate vectors of one name. Cosines at the threshold count (ties). An empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    runtime.prepare(spark)
    label = F.col(label_col) if label_col else F.lit(0)
    vectors = _vectors(rows.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("vec")))
    vectors = runtime.write_table(vectors, "vectors")
    linkable = vectors.filter("id IS NOT NULL AND label IS NOT NULL AND vhash IS NOT NULL")
    classes = linkable.groupBy("label", "vhash").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min_by("vec", "id").alias("vec"))
    classes = runtime.write_table(classes, "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    projections, tables = table_plan(most, cosine)
    posted = runtime.write_table(_posted(classes, projections, tables), "posted")

    entries = posted.select("rep", "n_dims", "label", "sketch", "step", "lost", F.posexplode("keys").alias("t", "bucket"))
    sizes = runtime.write_table(entries.groupBy("t", "bucket").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    placed = blocks.block_pairs(blocks.told(entries, sizes, ["t", "bucket"], "m"), "m", "rep", block).drop("m")
    own = "t int, bucket long, rep " + vectors.schema["id"].dataType.simpleString()
    active = runtime.write_table(blocks.by_unit(placed, "t", "bucket").mapInArrow(pieces.tidy(_active(cosine)), own).distinct(), "active")

    sizes = runtime.write_table(active.groupBy("t", "bucket").agg(F.count("*").alias("m")), "active_buckets")
    full = blocks.told(active, sizes, ["t", "bucket"], "m").join(classes.select("rep", "n", F.xxhash64("label").alias("label"), "vec"), "rep")
    full = blocks.by_unit(blocks.block_pairs(full.withColumn("n_dims", F.octet_length("vec")), "m", "rep", block).drop("m"), "t", "bucket")
    kind = vectors.schema["id"].dataType.simpleString()
    found = runtime.write_table(full.mapInArrow(pieces.tidy(_compare(cosine, projections, tables)), f"rep {kind}, links long, other {kind}"), "found")

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    known = classes.select("label", "vhash", "rep", "n").join(counts, "rep", "left").join(parts, "rep", "left")
    known = known.select("label", "vhash", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("least"))
    out = vectors.select("id", "label", F.when(F.col("id").isNotNull(), F.col("vhash")).alias("vhash")).join(known, ["label", "vhash"], "left")
    own = F.coalesce("least", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
