"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies. The whole
part is taken as it is; the fractional parts are rounded against each other:
two documents exchange probability mass, worth equally many words, until one
of them is integral; the other goes on. This runs in bounded groups of a source,
and the one residual of each group meets those of other groups in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, runtime

#: Weights by code-point order of the sources, repeated.
WEIGHTS = (3.0, 1.0, 2.0)
#: Documents of one source that one group rounds, and residuals that meet in one node of the tree.
GROUP_DOCS, FAN_IN = 2048, 64
#: A plan with at most so many sources is broadcast.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in above:
            out[i] = most * sizes[i]
            left -= out[i]
        closed = set(above)
        open_ = [i for i in open_ if i not in closed]
    return out


def pivot(shares: np.ndarray, sizes: np.ndarray, uniform: Callable[[int], np.ndarray]) -> int:
    """Round ``shares`` (in [0, 1]) in place, keeping the sum of share * size; the index left fractional, or -1.

    Each share's expectation stays what it was: of two open shares one gains a
    and the other loses it with probability b / (a + b), or the reverse with b.
    """
    draws, k, open_ = uniform(len(shares)), 0, -1
    for j in range(len(shares)):
        if not 0 < shares[j] < 1:
            continue
        if sizes[j] <= 0:
            shares[j] = float(draws[k] < shares[j])
            k += 1
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        mass_i, mass_j = shares[i] * sizes[i], shares[j] * sizes[j]
        a, b = min(sizes[i] - mass_i, mass_j), min(mass_i, sizes[j] - mass_j)
        gain = a if draws[k] * (a + b) < b else -b
        k += 1
        shares[i] = _snapped((mass_i + gain) / sizes[i])
        shares[j] = _snapped((mass_j - gain) / sizes[j])
        open_ = i if 0 < shares[i] < 1 else j if 0 < shares[j] < 1 else -1
    return open_


def _snapped(x: float) -> float:
    return 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x


def _round_group(level: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        pieces.release()
        table = table.sort_by([("size", "descending"), ("key", "ascending"), ("nth", "ascending")])
        shares, sizes = table.column("share").to_numpy().copy(), table.column("size").to_numpy()
        src, group = table.column("src")[0].as_py(), table.column("group")[0].as_py()
        left = pivot(shares, sizes, np.random.Generator(np.random.Philox([seed, level, src, group])).random)
        done = np.ones(len(shares), bool)
        if left >= 0:
            done[left] = False
        return table.set_column(table.column_names.index("share"), "share", pa.array(shares)).set_column(table.column_names.index("done"), "done", pa.array(done))

    return run


def ranked_sources(totals: DataFrame) -> DataFrame:
    """``totals`` (source, n, words) with ``src``, each source's place by code point, null last.

    A range partition sorts them; the driver learns how many sources each partition has, and no more.
    """
    order = [F.col("source").isNull(), F.col("source")]
    rows = totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = runtime.write_table(rows, "sources")
    held = rows.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    ahead, offsets = 0, []
    for r in held:
        offsets.append((r["part"], ahead))
        ahead += r["count"]
    before = rows.sparkSession.createDataFrame(offsets, "part long, ahead long")  # a row per partition
    rows = rows.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part")
    return rows.select("source", "n", "words", (F.col("ahead") + F.col("at") % F.lit(1 << 33)).alias("src"))


def level_of(sources: DataFrame, total: float, most: float) -> float:
    """Words per unit of weight, ``u``: targets are ``least(weight * u, most * words)`` and sum up to ``total``.

    Sources above their cap are closed and the rest is reshared until none is above.
    As closed sources are those whose cap per weight is below ``u``, each step is
    one sum over the sources, and only sums come to the driver.
    """
    cap, closed = F.lit(most) * F.col("words"), 0.0
    while True:
        shut = cap < F.col("weight") * F.lit(closed)
        row = sources.agg(F.sum(F.when(shut, cap).otherwise(0e0)).alias("held"), F.sum(F.when(shut, 0e0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            return closed
        unit = (total - row["held"]) / row["open"]
        if unit <= closed:
            return closed
        closed = unit


def _plan(totals: DataFrame, amount: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """A row per source: its rank, size, target, whole copies, fractional copy and number of groups."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("src") % len(weights) + 1).cast("int"))
    sources = runtime.write_table(ranked_sources(totals).withColumn("weight", weight), "ranked")
    total = amount * (sources.agg(F.sum("words")).first()[0] or 0)
    unit = level_of(sources, total, most)
    target = F.least(F.col("weight") * F.lit(unit), F.lit(float(most)) * F.col("words"))
    copies = F.when(F.col("words") > 0, target / F.col("words")).otherwise(0e0)
    whole = F.least(F.floor(copies + 1e-12), F.lit(math.floor(most))).cast("int")
    share = F.greatest(copies - whole, F.lit(0e0))
    snapped = F.when(share < 1e-9, 0e0).when(share > 1 - 1e-9, 1e0).otherwise(share)
    return sources.select("source", "src", F.col("words").alias("source_size"), target.alias("target"), whole.alias("whole"), snapped.alias("share"), F.greatest(F.ceil(F.col("n") / GROUP_DOCS), F.lit(1)).cast("long").alias("groups"))


def _apart(sized: DataFrame) -> DataFrame:
    """``sized`` with ``nth``, which tells rows apart that are equal in everything, in the same way on every run.

    Equal rows are counted and numbered; the numbers are made in chunks that are dealt out first.
    """
    counted = sized.groupBy("id", "source", "size", "key").agg(F.count("*").alias("m"))
    chunk = 4096
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / chunk))))
    dealt = chunks.filter("m <= 4096").unionByName(chunks.filter("m > 4096").repartition("key", "chunk"))
    nth = F.sequence(F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.col("m")) - 1)
    return dealt.withColumn("nth", F.explode(nth)).drop("m", "chunk")


def mix(
    docs: DataFrame, amount: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, residual: str = "split", seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, ``size, source_size, target, taken`` and ``copies``.

    ``size`` is the number of words, ``copies`` (double) how often the mix
    takes the document and ``taken`` the words it takes: a whole number of
    copies, but for at most one document per source, which is left fractional
    when its source's tree ends. ``residual="split"`` takes the matching part of
    its words, so that a source's words equal its target rounded;
    ``residual="round"`` rounds it at random, so that every copy is whole.

    Draws depend on the rows alone (id, text, size, source, and a number that tells
    equal rows apart), so reruns agree, and equal rows spread over all groups.
    A null text has size 0; a null source is a source of its own, last in
    order; a source without words has target 0. Null ids are rounded like any
    others. Repeated rows are separate rows of equal chances. Long texts are counted whole; ties in size go by
    a hash of the row. An empty table gives no rows; further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(id_col), text).alias("key"),
    )
    sized = runtime.write_table(sized, "sizes")
    totals = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    plan = runtime.write_table(_plan(totals, amount, most, weights), "plan")
    n_sources, groups = plan.agg(F.count("*"), F.max("groups")).first()
    small = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    rows = _apart(sized).join(small.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    group = F.pmod(F.xxhash64("key", "nth"), "groups")
    rows = rows.select("id", "size", "source_size", "target", "whole", "share", "src", "key", "nth", group.alias("group"), F.lit(True).alias("done"))
    settled, level, groups = None, 0, groups or 1
    while True:
        rows = runtime.write_table(rows.groupBy("src", "group").applyInArrow(_round_group(level, seed), rows.schema), f"level{level}")
        settled = rows if settled is None else settled.unionByName(rows)
        if groups <= 1:
            break
        settled = settled.filter("done")
        rows = rows.filter("NOT done").withColumn("group", F.expr(f"group div {FAN_IN}"))
        groups, level = math.ceil(groups / FAN_IN), level + 1
    share = F.col("share")
    if residual == "round":
        draw = F.pmod(F.xxhash64(F.lit(seed), "key", "nth"), F.lit(1 << 30)) / float(1 << 30)
        share = F.when(F.col("done"), share).otherwise((draw < share).cast("double"))
    copies = F.col("whole") + share
    return settled.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.round(share * F.col("size")).cast("long")).alias("taken"), copies.alias("copies"),
    )


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as ``mixed`` (made with ``residual="round"``) says.

    Rows that share an id get the most copies that any of them was given; a null
    id matches itself. Texts aren't looked at, so empty and long ones are like any others; empty tables
    give no rows. Columns keep their names and values, whatever they are called.
    """
    own_id, copies, nth = (runtime.fresh(docs.columns, c) for c in ("mixed_id", "mixed_copies", "nth_copy"))
    times = mixed.groupBy(F.col(id_col).alias(own_id)).agg(F.max("copies").cast("int").alias(copies)).filter(F.col(copies) > 0)
    joined = docs.join(times, F.col(id_col).eqNullSafe(F.col(own_id)))
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
