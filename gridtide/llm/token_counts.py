"""Token counts without ids: Arrow batches go in, lengths come out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, runtime


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``tokenizer`` is the path of a vocabulary file. Encoding is batched by bytes
    in an Arrow function, long texts are cut at safe boundaries (see ``pieces``),
    and only lengths return. There is no shuffle and no model state to move.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids, repeated rows and
    ties stay as they are, one output row each; an empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    runtime.prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces.encoder(tokenizer, ids=False)
        for batch in batches:
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            tokens = [lens for *_, lens in own.batches(batch.column(1))]
            n = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(n), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(pieces.tidy(count, encodes=True), f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
