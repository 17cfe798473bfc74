"""From raw documents to packed training sequences, in five stages.

Each stage works on everything that its predecessor kept; all but the last return
the columns of ``documents``. Rows with a null doc_id can't be named in a
decision of the deduplication stages, which therefore keep them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from gridtide.llm import pieces, runtime
from gridtide.llm.exact_dedup import drop_exact_duplicates
from gridtide.llm.mixing import mix, repeat_documents
from gridtide.llm.near_dedup import near_dedup
from gridtide.llm.packing import pack
from gridtide.llm.quality import keep_good
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking learned from ``labels`` rejects go.

    Null, empty and blank texts are scored like any other, by features that are zero, and long ones whole; a score just
    at the threshold (a tie) stays. Repeated rows go or stay together. Without labels of both kinds all stay.
    """
    return keep_good(docs, runtime.read_table(spark, sf_dir, "labels"), fold=1, folds=3)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays, then the smallest doc_id.

    A null text counts as empty, so one of all null, empty and blank texts stays. Rows with a null doc_id stay, but for
    repeated ones of the same text; of repeated rows one stays. Long texts are hashed whole; an empty table gives no rows.
    """
    return drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (shingles of five words, similarity 0.8 or more).

    Texts that share a doc_id are documents of their own, ordered by a hash of the text. Null and blank texts are near
    nothing and stay, as do rows with a null doc_id; long texts are compared whole; an empty table gives no rows.
    """
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        own = runtime.fresh(docs.columns, "gone_id")
        found = lambda: near_dedup(docs.select("doc_id", "text"), words=5, percent=80)
        dropped = runtime.settled(lambda: found().filter("NOT kept").select(F.col("doc_id").alias(own)), "dropped")
        return runtime.without(docs, dropped, "doc_id", own, lambda x: x["doc_id"] == F.col(own))
    text, row = (runtime.fresh(docs.columns, c) for c in ("whole_text", "row_number"))
    keyed = docs.withColumn(text, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    keys = keyed.filter("doc_id IS NOT NULL").select("doc_id", text).distinct().orderBy("doc_id", text)
    keys = runtime.write_table(keys.withColumn(row, F.monotonically_increasing_id()), "rows")  # in the order of the ids
    numbered = runtime.write_table(keyed.join(keys, ["doc_id", text], "left"), "numbered")
    dropped = runtime.settled(lambda: near_dedup(numbered, words=5, percent=80, id_col=row).filter("NOT kept").select(row).distinct(), "dropped")
    return numbered.join(dropped, row, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are repeated or left out as whole copies.

    A null source is one of its own, last in order; a source without words (null, empty and blank texts only) is left out.
    Rows that share a doc_id get the copies of the best of them. Ties in size go by a hash of the row; an empty table gives no rows.
    """
    return repeat_documents(docs, mix(docs, amount=1.5, most=2.0, residual="round"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences.

    A null or empty text is the end id alone; long ones are cut into several pieces; repeated rows are packed one by one.
    The columns are those of ``pack``; those of the documents don't matter, whatever their names.
    """
    return pack(docs, pieces.tokenizer_path("word_bpe_49k.json"), capacity=2048, end=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: A learned ranking and random rounding aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next; only what they return stays on disk."""
    docs = runtime.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = runtime.settled(partial(stage, spark, docs, sf_dir), f"stage_{name}")
    return docs
