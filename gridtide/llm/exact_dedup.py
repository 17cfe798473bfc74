"""Exact duplicates by a tree-merge of sorted digest runs.

Only DataFrame and SQL functions. Every row becomes a digest entry of one of
``RUNS`` runs. A run is kept in slices by the digest's first byte, each of them sorted by digest.
In binomial rounds ``2**bits`` runs meet slice by slice: their sorted slices are
exchanged, merged in one order, and of equal digests the smallest entry
(longest text, smallest id) is retained with the count. What the last run
knows goes down the tree again: to the entries of the first round's runs, and from there
to the rows. A text that holds a third of all rows is thus one entry a run on the way up, and
on the way down its rows are dealt by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

#: What normalisation deletes: ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"
#: Runs of the first round, and how many (as a power of two) are merged into one.
RUNS, BITS = 256, 4
#: Entries are equal when these are: SHA-256, another hash and the length of the normalised text.
IDENTITY = ("digest", "check", "n_bytes")


def normalised(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), BLANKS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, digest, check, n_bytes``: SHA-256 of the normalised text, and what verifies that it is the same text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("n_chars"), normalised(text_col).alias("norm"))
    return rows.select("id", "n_chars", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("check"), F.octet_length("norm").alias("n_bytes"))


def run_of(runs: int) -> Column:
    """The run of a row: by its id and length, so that equal texts spread over all runs."""
    return F.pmod(F.xxhash64("id", "n_chars"), F.lit(runs)).cast("int")


def first_runs(entries: DataFrame, runs: int = RUNS) -> DataFrame:
    """``run, digest, check, n_bytes, best, n``: each run's entries, combined before the exchange."""
    best = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("no_id"), F.col("id"))
    own = entries.select(run_of(runs).alias("run"), *IDENTITY, best.alias("best"), F.lit(1).cast("long").alias("n"))
    return own.groupBy("run", *IDENTITY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def merge_runs(merged: DataFrame, runs: int = RUNS, bits: int = BITS) -> DataFrame:
    """``digest, check, n_bytes, best, n`` of each distinct text: ``2**bits`` runs into one, until one is left.

    The exchange is by run and slice; slices arrive sorted, are merged in one order and
    aggregated in that order, without another exchange. A merged slice has at most
    ``2**bits`` entries of a digest.
    """
    if runs & (runs - 1):
        raise ValueError("runs must be a power of two")
    merged = merged.withColumn("slice", F.substring("digest", 1, 1))
    order = ("run", "slice", *IDENTITY)
    left = runs
    while left > 1:
        step = min(bits, left.bit_length() - 1)
        left >>= step
        if left == 1:  # one run: its slices are as fine as Spark's partitions
            merged = merged.withColumn("slice", F.substring("digest", 1, 4))
        met = merged.withColumn("run", F.shiftright("run", step)).repartition("run", "slice").sortWithinPartitions(*order)
        merged = met.groupBy(*order).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return merged.drop("run", "slice")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after deleting ASCII white space; of equal
    texts the one with the most code points stays, then the smallest id (ties).

    A null text counts as empty. Texts are hashed whole, however long. A null id is last among equals, and
    is kept only if its whole group has none. Rows that repeat an id and a
    normalised text have the same result, so all of them are kept or none. An empty
    table gives no rows; further columns are ignored, whatever their names.
    """
    entries = runtime.write_table(digests(docs, id_col, text_col).withColumn("run", run_of(RUNS)), "digests")
    runs = runtime.write_table(first_runs(entries), "runs")
    winners = merge_runs(runs).select(*IDENTITY, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))
    told = runs.select("run", *IDENTITY).join(winners, list(IDENTITY))  # at most RUNS entries of a text
    joined = entries.join(told, ["run", *IDENTITY])
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns; rows that repeat an id and a text go as well.

    A decision holds for an id and a normalised text, so of rows that share an id only those go whose text has a better row.
    Rows with a null id stay, but for repeated ones of the same text. Texts are shuffled only where their id may be one
    that goes (``runtime.without``). Columns keep their names, whatever they are. Other cases: as ``exact_dedup``.
    """
    own_id, digest, whole = (runtime.fresh(docs.columns, c) for c in ("gone_id", "gone_digest", "whole_text"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    decided = runtime.settled(lambda: exact_dedup(texts, "id", "text").select("id", "kept", "text_sha256"), "decided")
    dropped = decided.filter("NOT kept AND id IS NOT NULL").select(F.col("id").alias(own_id), F.col("text_sha256").alias(digest)).distinct()
    same = lambda x: (x[id_col] == F.col(own_id)) & (F.sha2(normalised(text_col), 256) == F.col(digest))
    left = runtime.without(docs, dropped, id_col, own_id, same)
    if decided.groupBy("id", "text_sha256").count().filter("count > 1").isEmpty():
        return left
    keyed = left.withColumn(whole, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    return keyed.dropDuplicates([id_col, whole]).select(docs.columns)
