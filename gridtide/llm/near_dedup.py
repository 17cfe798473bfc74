"""Near duplicates by an inverted join of MinHash coordinates.

Each distinct shingle set posts itself under its (coordinate, value) pairs. A
link needs ``least`` equal coordinates of ``n``; so when every set orders its
pairs from the rarest to the most frequent, two linked sets share one of their
first ``n - least + 1``: only these prefixes are posted, and pairs that no other
set has are skipped. Candidates are counted on whole signatures and confirmed
on whole shingle sets.

Links are looked for in two passes. First each posted list is checked against
its smallest member, and what this links is united. Then lists that still hold
several components are searched for links between components: a further link
inside a component would change nothing, so none is lost. Short lists are joined
(``SHORT`` members give a bounded number of pairs); long ones are compared
block by block inside tasks, which return links only, each pair in the first list
that it shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, pieces, runtime
from .components import connected_components
from .shingles import shingle_sets, signatures

#: Coordinates that are posted, coordinates that candidates are counted on (the posted ones among them), and by how many
#: deviations a count may fall short: a link at the threshold itself is missed with a chance below 2 in 10,000.
COORDINATES, COUNTED, DEVIATIONS = 64, 160, 4.0
BATCH_BYTES = 1 << 19
#: Members of a list that is searched by a join, and of a block of a longer one.
SHORT, BLOCK = 8, 2048
#: Bytes of whole sets that a block has, as planned by their sizes.
BLOCK_BYTES = 4 << 20


def least_matches(n: int, threshold: float) -> int:
    """Equal coordinates that candidates need: ``DEVIATIONS`` below what the threshold leads to expect."""
    return max(1, math.floor(n * threshold - DEVIATIONS * math.sqrt(n * threshold * (1 - threshold))))


def set_features(docs: DataFrame, words: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, set_hash, signature, counted`` of each row; no hash or signature without words.

    ``signature`` has the ``n`` posted values, ``counted`` 16 bits of each of ``COUNTED`` values.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces.text_batches(batch.column(1), BATCH_BYTES):
                sets = shingle_sets([x.encode() if x else b"" for x in texts], words)
                full = np.array([len(x) > 0 for x in sets])
                values = signatures(sets, max(n, COUNTED))
                flat = pa.array(np.ascontiguousarray(values[:, :n]).view(np.int32).ravel())
                short = iter(values[:, :COUNTED].astype("<u2"))
                offsets = np.concatenate([[0], np.cumsum(full * n)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                        pa.array([next(short).tobytes() if x else None for x in full], pa.binary()),
                    ],
                    names=["id", "n_shingles", "set_hash", "signature", "counted"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(pieces.tidy(run), f"id {kind}, n_shingles long, set_hash binary, signature array<int>, counted binary")


def prefix_postings(sets: DataFrame, n: int, least: int) -> DataFrame:
    """``key, rep, size, df``: the posted prefix of each set (``rep, size, signature``), without pairs of one set only."""
    pairs = sets.select("rep", "size", F.posexplode("signature").alias("j", "value"))
    pairs = pairs.select("rep", "size", (F.shiftleft(F.col("j").cast("long"), 32) + F.col("value").cast("long")).alias("key"))
    shared = runtime.write_table(pairs.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    own = Window.partitionBy("rep")
    ranked = blocks.told(pairs, shared, ["key"], "df").withColumns({"rank": F.row_number().over(own.orderBy("df", "key")), "n_shared": F.count("*").over(own)})
    return ranked.filter(F.col("rank") <= n - least + 1 - (n - F.col("n_shared"))).select("key", "rep", "size", "df")


def _similar_sizes(a: str, b: str, percent: int) -> F.Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def matching(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose signatures agree in ``least`` of the counted coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.filter(pa.array((left == right).sum(1) >= least)).select(["a", "b"])

    side = lambda x: sets.select(F.col("rep").alias(x), F.col("counted").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(pieces.tidy(run), both.select("a", "b").schema)


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id, own``: the sorted shingle set (bytes of u64) of each document whose id is in ``wanted``.

    Texts are shuffled only if the hash of their id is one of a wanted id's;
    there are ``runtime.SIEVE`` hashes, so that broadcast is bounded at any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, texts in pieces.text_batches(batch.column(1), BATCH_BYTES):
                sets = shingle_sets([t.encode() if t else b"" for t in texts], words)
                yield pa.RecordBatch.from_arrays([batch.column(0)[x:y], pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "own"])

    wanted, place = wanted.distinct(), runtime.sieve_place("id").alias("place")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("place", place).join(F.broadcast(wanted.select(place).distinct()), "place", "left_semi").drop("place")
    texts = texts.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    return texts.mapInArrow(pieces.tidy(run), f"id {texts.schema['id'].dataType.simpleString()}, own binary")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b) or 100 * len(b) < percent * len(a):
        return False
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are alike in their whole ``sets`` (id, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [_alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in both]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    side = lambda x: sets.select(F.col("id").alias(x), F.col("own").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(pieces.tidy(run), both.select("a", "b").schema)


def _promising(unit: pa.Table, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the unit's rows that may be links between components and share no earlier list."""
    left, right, same = blocks.sides(unit)
    counted = np.frombuffer(b"".join(unit.column("counted").to_pylist()), "<u2").reshape(unit.num_rows, -1)
    part, size = unit.column("part").to_numpy(), unit.column("size").to_numpy()
    xs, ys = [], []
    for k in range(0, len(left), 32):
        rows = left[k : k + 32]
        fit = (part[rows, None] != part[right]) & (100 * np.minimum(size[rows, None], size[right]) >= percent * np.maximum(size[rows, None], size[right]))
        if same:
            fit &= rows[:, None] < right
        x, y = np.nonzero(fit)
        if len(x):
            near = (counted[rows[x]] == counted[right[y]]).sum(1) >= least
            xs.append(rows[x[near]])
            ys.append(right[y[near]])
    if not xs or not sum(map(len, xs)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(xs), np.concatenate(ys)
    lists = [np.array(p, np.int64) for p in unit.column("prefix").to_pylist()]
    width, key = max(map(len, lists)), unit.column("key")[0].as_py()
    table = np.zeros((len(lists), width), np.int64)
    earlier, held = np.zeros(table.shape, bool), np.zeros(table.shape, bool)
    for r, p in enumerate(lists):
        table[r, : len(p)], held[r, : len(p)] = p, True
        earlier[r, : np.flatnonzero(p == key)[0]] = True
    first = np.ones(len(x), bool)
    for k in range(0, len(x), 4096):
        a, b = x[k : k + 4096], y[k : k + 4096]
        shared = (table[a][:, :, None] == table[b][:, None, :]) & earlier[a][:, :, None] & held[b][:, None, :]
        first[k : k + 4096] = ~shared.any((1, 2))
    return x[first], y[first]


def _active(least: int, percent: int):
    """``key, rep`` of the rows that have a promising partner in a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in blocks.units(batches, "key"):
            x, y = _promising(unit, least, percent)
            if len(x):
                rows = pa.array(np.unique(np.concatenate([x, y])))
                yield unit.select(["key", "rep"]).take(rows).combine_chunks().to_batches()[0]

    return run


def _linked(least: int, percent: int):
    """``a, b``: a forest of the unit's links, confirmed on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in blocks.units(batches, "key"):
            x, y = _promising(unit, least, percent)
            if not len(x):
                continue
            rep, sets = unit.column("rep"), [np.frombuffer(s, np.uint64) for s in unit.column("own").to_pylist()]
            links = [(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True) if _alike(sets[i], sets[j], percent)]
            if links:
                a, b = np.array(links).T
                top = blocks.forest(a, b, len(sets))
                low = np.flatnonzero(top != np.arange(len(sets)))
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(low)).combine_chunks(), rep.take(pa.array(top[low])).combine_chunks()], names=["a", "b"])

    return run


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, n: int = COORDINATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``.

    Texts are linked when their sets of ``words``-word shingles (words are runs
    of non-blanks, A-Z as a-z; fewer words are one shingle) have
    ``100 * intersection >= percent * union``. A component's id is the smallest
    document id that links reach; ``kept`` is true for that document.

    A null or blank text has no shingles and is linked with nothing. A row with
    a null id is linked with nothing: its component is null, and it is kept.
    Rows that repeat an id are taken for the same document and get
    the same result. Equal sets are one class, joined through its smallest id; similarities at the threshold count (ties).
    Whole texts are shingled; long ones meet in smaller blocks. An empty table gives no rows; further columns are ignored, whatever
    their names.
    """
    runtime.prepare(docs.sparkSession)
    least, most_counted = least_matches(n, percent / 100), least_matches(COUNTED, percent / 100)
    rows = runtime.write_table(set_features(docs, words, n, id_col, text_col), "sets")
    linked = rows.filter("id IS NOT NULL AND set_hash IS NOT NULL")
    classes = linked.groupBy("set_hash").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("size"), F.min_by(F.struct("signature", "counted"), "id").alias("own"))
    classes = classes.select("set_hash", "rep", "size", "own.signature", "own.counted")
    classes = runtime.write_table(classes, "classes")
    posted = runtime.write_table(prefix_postings(classes, n, least), "postings")

    first = posted.groupBy("key").agg(F.min_by(F.struct("rep", "size"), "rep").alias("hub"), F.count("*").alias("m"))
    first = runtime.write_table(first.filter("m > 1"), "hubs")
    star = blocks.told(posted, first, ["key"], "m").filter(F.col("rep") != F.col("hub.rep")).filter(_similar_sizes("size", "hub.size", percent))
    star = star.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).distinct()
    candidates = runtime.write_table(matching(star, classes, most_counted), "star_candidates")
    sets = runtime.write_table(whole_sets(docs, _ends(candidates), words, id_col, text_col), "star_sets")
    links = runtime.write_table(confirmed(candidates, sets, percent), "star_links")
    parts = runtime.write_table(connected_components(links), "parts")

    placed = posted.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("m")).filter("low < high").select("key", "m")
    open_ = runtime.write_table(blocks.told(placed, runtime.write_table(mixed, "mixed"), ["key"], "m"), "open")
    left, right = (open_.filter(F.col("m") <= SHORT).select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "size", "part"))) for x in "ab")
    cross = left.join(right, "key").filter("part_a < part_b").filter(_similar_sizes("size_a", "size_b", percent))
    cross = cross.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    candidates = runtime.write_table(matching(cross, classes, most_counted), "cross_candidates")
    prefixes = posted.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("prefix"))
    prefixes = prefixes.select("rep", F.transform("prefix", lambda x: x["key"]).alias("prefix"))
    long_ = blocks.block_pairs(open_.filter(F.col("m") > SHORT), "m", "rep", BLOCK).select("key", "rep", "size", "part", "block", "i", "j")
    full = blocks.by_unit(long_.join(prefixes, "rep").join(classes.select("rep", "counted"), "rep"), "key")
    active = full.mapInArrow(pieces.tidy(_active(most_counted, percent)), full.select("key", "rep").schema).distinct()
    active = runtime.write_table(active, "active")
    sets = whole_sets(docs, _ends(candidates).unionByName(active.select(F.col("rep").alias("id"))), words, id_col, text_col)
    sets = runtime.write_table(sets, "cross_sets")
    more = confirmed(candidates, sets, percent)
    full = open_.drop("m").join(active, ["key", "rep"], "left_semi")
    sums = runtime.write_table(full.groupBy("key").agg(F.count("*").alias("m"), (8 * F.sum("size")).alias("bytes")), "sums")
    full = blocks.block_pairs(blocks.told(full, sums, ["key"], "m"), "m", "rep", BLOCK, "bytes", BLOCK_BYTES).drop("m", "bytes", "df")
    full = full.join(prefixes, "rep").join(classes.select("rep", "counted"), "rep")
    full = blocks.by_unit(full.join(sets.withColumnRenamed("id", "rep"), "rep"), "key")
    more = more.unionByName(full.mapInArrow(pieces.tidy(_linked(most_counted, percent)), more.schema))
    more = runtime.write_table(more, "cross_links")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))

    found = classes.select("set_hash", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "n_shingles", "set_hash").join(found, "set_hash", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
