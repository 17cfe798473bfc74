"""Best-fit packing of token sequences, by a tree of residual rounds.

Every document is cut into pieces of at most ``capacity`` tokens. A full piece
is a sequence by itself. The others are packed best-fit, largest first, in
bounded groups; nearly full bins are final there. Each underfull bin goes on as
one item to the next round, where several groups meet, until one group is left.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, runtime

#: Items that one group packs, as planned by counts.
GROUP_ITEMS = 4096
#: A bin with at most so many tokens to spare is final.
SLACK = 16


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces: ``id, piece, start, length, ids_crc32`` and ``mark``, a number of the row for itself."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mark = pieces.encoder(tokenizer), TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, _, ids, lens in own.batches(batch.column(1), end):
                ids = np.ascontiguousarray(ids, dtype="<u4")
                n_pieces = -(-lens // capacity)
                row = np.repeat(np.arange(len(lens)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(lens[row] - start, capacity)
                at = (np.cumsum(lens) - lens)[row] + start
                crc = [zlib.crc32(ids[x : x + n]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                marks = mark + np.arange(len(row))
                mark += len(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + a)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(marks)],
                    names=["id", "piece", "start", "length", "ids_crc32", "mark"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(pieces.tidy(cut, encodes=True), f"id {kind}, piece int, start long, length long, ids_crc32 long, mark long")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each item, in the order given: each goes where the least room is left over.

    Also the number of bins. Give the largest items first for best-fit decreasing.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    rooms = 0  # bit r: some bin has r free
    bins, offsets, n = [], [], 0
    for size in sizes:
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        bins.append(b)
        offsets.append(capacity - room)
        left = room - size
        if not waiting[left]:
            rooms |= 1 << left
        waiting[left].append(b)
    return bins, offsets, n


def _fit_group(level: int, capacity: int):
    """Items (``bin, fill, group``) of one group in; each item's ``bin`` with its ``base`` and ``total`` in ``to`` out."""

    def fit(table: pa.Table) -> pa.Table:
        pieces.release()
        items, sizes = table.column("bin").to_numpy(), table.column("fill").to_numpy()
        group = table.column("group")[0].as_py()
        order = np.lexsort((items, -sizes))
        bins, bases, n = best_fit(sizes[order].tolist(), capacity)
        own, base = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
        own[order], base[order] = bins, bases
        total = np.bincount(own, sizes, n).astype(np.int64)
        return pa.table({"bin": pa.array(items), "to": pa.array((level << 56) + (group << 24) + own), "base": pa.array(base), "total": pa.array(total[own])})

    return fit


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text",
    group_items: int = GROUP_ITEMS, slack: int = SLACK,
) -> DataFrame:
    """One row per piece: id, ``piece, start, length, ids_crc32, sequence_id, offset``.

    A group holds some ``group_items`` items, however large the input; groups
    are drawn by a hash of the row's own mark, so repeated ids spread. In later rounds a
    bin is one row, however many pieces it has, and only bins meet that are small enough to
    fit with the smallest open one. Rounds end when one group is left, or when a round
    united nothing.

    A null text counts as empty: one piece, the end id alone. Long texts are cut into pieces of ``capacity``. Null ids and
    repeated rows are packed like any others; ties in length go by the mark. An empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    runtime.prepare(docs.sparkSession)
    cut = runtime.write_table(cut_documents(docs, tokenizer, capacity, end, id_col, text_col), "pieces")
    items = cut.filter(F.col("length") < capacity).select(F.col("mark").alias("bin"), F.col("length").alias("fill"))
    n, placed, level = items.count(), None, 1
    groups = max(1, math.ceil(n / group_items))
    while n:
        dealt = items.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)))
        fitted = dealt.groupBy("group").applyInArrow(_fit_group(level, capacity), "bin long, to long, base long, total long")
        fitted = runtime.write_table(fitted, f"round{level}")
        if placed is None:  # where each piece is: mark, bin and offset
            placed = fitted.select(F.col("bin").alias("mark"), F.col("to").alias("bin"), F.col("base").alias("offset"))
        else:
            moved = placed.join(fitted.select("bin", "to", "base"), "bin", "left")
            placed = moved.select("mark", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
        if groups == 1 or level == 127:
            break
        bins = fitted.filter(F.col("total") < capacity - slack).select(F.col("to").alias("bin"), F.col("total").alias("fill")).distinct()
        least = bins.agg(F.min("fill")).first()[0]
        if least is None:
            break
        items = bins.filter(F.col("fill") <= capacity - least)
        before, n, level = n, items.count(), level + 1
        if level > 2 and n >= before:
            break
        groups = math.ceil(n / group_items)
    full = cut.filter(F.col("length") == capacity).withColumns({"bin": F.col("mark"), "offset": F.lit(0).cast("long")})
    columns = ["id", "piece", "start", "length", "ids_crc32", "bin", "offset"]
    out = full.select(columns)
    if placed is not None:
        out = out.unionByName(cut.filter(F.col("length") < capacity).join(placed, "mark").select(columns))
    return _named(out, id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
