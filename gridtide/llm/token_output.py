"""Token ids of a corpus as coded shards, and their way back.

Documents are range-partitioned by id and sorted; each partition encodes its
texts and writes shards of some millions of ids, whole documents each. A shard
is one row of a Parquet table in the shared folder: Spark's commit protocol
keeps the output whole when executors are lost, and any store that Spark
writes to will do. The ids are one binary value in the format of
``context_coder``; ids of documents and their lengths stand beside it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context_coder, pieces, runtime

#: Ids of a shard, which ends with a document. A task's last shard has up to twice as many: small ones are slow, as
#: all blocks of a shard are coded in lockstep.
SHARD_IDS = 4_000_000


def write_token_shards(docs: DataFrame, tokenizer: str, end: int, path: str | None = None, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, ``end`` appended to each, in ascending id order; the shard table.

    Columns: ``part`` and ``seq`` (order of the shards), ``before`` (ids of the
    part before this shard), ``n_ids``, ``ids`` and ``lengths`` of the
    documents, ``data``. It is written to ``path``, else to the shared folder.
    Null and empty texts have the end id alone, long ones are encoded whole; rows that repeat an
    id, or have none, may lie in several parts, next to each other. An empty
    table gives no shards; further columns are ignored, whatever their names.
    """
    runtime.prepare(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = pieces.encoder(tokenizer), TaskContext.get().partitionId()
        ids, lens, names, held, seq, before = [], [], [], 0, 0, 0

        def shard(parts: int) -> pa.RecordBatch:
            """The first ``parts`` batches of texts."""
            own, lengths, named = ids[:parts], np.concatenate(lens[:parts]), pa.concat_arrays(names[:parts])
            row = [
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), named),
                pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.array(lengths)),
                pa.array([context_coder.encode(np.concatenate(own))], pa.binary()),
            ]
            del ids[:parts], lens[:parts], names[:parts]
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "before", "n_ids", "ids", "lengths", "data"])

        for batch in batches:
            for a, b, more, lengths in own.batches(batch.column(1), end, min(pieces.BATCH_BYTES, 2 * shard_ids)):
                ids.append(more.astype(np.uint32))
                lens.append(lengths)
                names.append(batch.column(0)[a:b])
                held += len(more)
                if held >= 2 * shard_ids:
                    sizes = np.cumsum([len(x) for x in ids])
                    first = int(np.searchsorted(sizes, shard_ids)) + 1
                    yield shard(first)
                    seq, before, held = seq + 1, before + int(sizes[first - 1]), held - int(sizes[first - 1])
        if held:
            yield shard(len(ids))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("mark"))
    kind = rows.schema[0].dataType.simpleString()
    ordered = rows.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark")  # by mark, rows that repeat an id spread
    shards = ordered.mapInArrow(pieces.tidy(write, encodes=True), f"part int, seq int, before long, n_ids long, ids array<{kind}>, lengths array<long>, data binary")
    if path is None:
        return runtime.write_table(shards, "shards")
    shards.write.parquet(path)
    return docs.sparkSession.read.schema(shards.schema).parquet(path)


def read_token_shards(shards: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids`` of each document, decoded: ids as an array. No shards give no rows; damaged ones raise."""
    return _decoded(shards, "ids array<int>", lambda ids: pa.array(ids.astype(np.int32)), nested=True)


def token_digests(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document's id, ``start``, ``n_tokens`` and ``ids_crc32``, from the coded shards."""
    rows = _decoded(shards, "ids_crc32 long", zlib.crc32, nested=False)
    return rows.select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")


def _decoded(shards: DataFrame, column: str, digest, nested: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                all_ids = np.ascontiguousarray(context_coder.decode(batch.column(3)[k].as_py()), dtype="<u4")
                names, lengths = batch.column(1)[k].values, batch.column(2)[k].values.to_numpy()
                stops = np.cumsum(lengths)
                starts = stops - lengths
                if len(names) != len(lengths) or int(lengths.sum()) != len(all_ids):
                    raise ValueError("the lengths of a shard's documents don't fit its ids")
                if nested:
                    values = pa.ListArray.from_arrays(pa.array(np.append(starts, stops[-1:]), pa.int32()), digest(all_ids))
                else:
                    values = pa.array([digest(all_ids[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.int64())
                start = pa.array(starts + batch.column(0)[k].as_py())
                yield pa.RecordBatch.from_arrays([names, start, pa.array(lengths), values], names=["id", "start", "n_tokens", column.split()[0]])

    spark = shards.sparkSession
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    ahead, placed = 0, []
    for part, n in totals:
        placed.append((part, ahead))
        ahead += n
    offsets = spark.createDataFrame(placed, "part int, ahead long")  # a row per write task
    rows = shards.join(F.broadcast(offsets), "part").select((F.col("ahead") + F.col("before")).alias("ahead"), "ids", "lengths", "data")
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    return rows.mapInArrow(pieces.tidy(run), f"id {kind}, start long, n_tokens long, {column}")


def tokenize_corpus(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the coded shards of ``docs``, read them back: one row per row of ``docs``.

    A null text counts as empty and has the end id alone; a long one is encoded whole. Rows with a null id
    come first; rows that repeat an id follow each other in any order. An empty
    table gives no rows; further columns are ignored, whatever their names.
    """
    return token_digests(write_token_shards(docs, tokenizer, end, id_col=id_col, text_col=text_col), id_col)
