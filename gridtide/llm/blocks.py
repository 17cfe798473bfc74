"""Comparing all members of large groups with each other, in bounded tasks.

A group is cut into blocks of some hundred members, and each pair of its blocks is
one unit of work. No task holds more than two blocks, and no pair of
members becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block.
BLOCK = 512
#: Keys that hold more than one of so many parts of all rows count as hot; so there are fewer than this.
HOT_KEYS = 4096


def told(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``facts``, one row for each of some ``keys``, whose column ``count`` is the key's number of rows.

    A key with more than ``1 / HOT_KEYS`` of these rows is hot: there are fewer
    than ``HOT_KEYS`` such, so their facts are broadcast, and rows of a hot key stay
    where they are. All others meet in an exchange by key. ``facts`` should be a written table.
    """
    most = (facts.agg(F.sum(count)).first()[0] or 0) / HOT_KEYS
    hot = facts.filter(F.col(count) > most)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(facts.filter(F.col(count) <= most), keys)
    return near.unionByName(far)


def block_pairs(rows: DataFrame, size: str, member: str, block: int = BLOCK, weight: str | None = None, most: int = 1) -> DataFrame:
    """``rows`` once for each pair of blocks that their own block is in: ``block``, and the pair ``i <= j``.

    ``size`` names the column with the number of members of a row's group,
    ``weight`` one with the group's weight, of which a block gets about ``most``.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.col(weight) / most).cast("int"))
    placed = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("blocks", "with")


def by_unit(rows: DataFrame, *keys: str) -> DataFrame:
    """Every unit of work (``keys``, ``i``, ``j``) in one task, its rows next to each other."""
    names = [*keys, "i", "j"]
    return rows.repartition(*names).sortWithinPartitions(*names)


def units(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The consecutive units of a partition that ``by_unit`` made."""
    names, held = [*keys, "i", "j"], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        group = np.stack([table.column(c).to_numpy() for c in names])
        starts = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0)]))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def sides(unit: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the unit's first and second block, and whether they are the same block."""
    i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
    block = unit.column("block").to_numpy()
    left = np.flatnonzero(block == i)
    return (left, left, True) if i == j else (left, np.flatnonzero(block == j), False)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least node that the links (a, b) reach."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new
