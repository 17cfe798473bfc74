"""Shared plumbing: the shared work folder, written tables and worker imports."""

from __future__ import annotations

import atexit
import contextvars
import functools
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO_ROOT = str(Path(__file__).resolve().parents[2])
_written: list[tuple[SparkSession, str]] = []
#: Of the innermost ``settled`` that is at work in this thread: the tables written on its way.
_on_the_way: contextvars.ContextVar[list[tuple[SparkSession, str]] | None] = contextvars.ContextVar("on_the_way", default=None)


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="gridtide-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is read from the session. Only where it is unset, as in tests on one
    machine, a fresh temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir()
    return base.rstrip("/")


#: Bytes of an Arrow batch, which Spark and a Python worker both hold; Spark's own default is 64 MB.
ARROW_BYTES = "4m"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver found it, and keep Arrow batches small.

    A size of batches that the session has set itself stays as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":
        spark.conf.set(key, ARROW_BYTES)
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if REPO_ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO_ROOT, path) if x)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there.

    This cuts the lineage: a lost executor costs no recomputation of what came
    before, because the files outlive it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridtide-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    if (own := _on_the_way.get()) is not None:
        own.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, written by ``write_table``; the tables that ``make`` wrote on its way are then deleted.

    Nothing but its result may be read later, so ``make`` must not hand out other DataFrames. If it fails, its tables stay
    until the end, as others do.
    """
    own: list[tuple[SparkSession, str]] = []
    outer = _on_the_way.set(own)
    try:
        df = make()
    finally:
        _on_the_way.reset(outer)
    out = write_table(df, name)
    for spark, path in own:
        _delete(spark, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_written() -> None:
    """Delete every table that ``write_table`` wrote in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; the shared folder is then cleaned from outside
            return


atexit.register(drop_written)


def fresh(taken: list[str], name: str) -> str:
    """``name``, made longer until no column in ``taken`` has it (case doesn't tell names apart)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


#: Distinct hashes that a sieve of ids has at most, so that its broadcast is bounded at any size.
SIEVE = 1 << 20


def sieve_place(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(SIEVE))


def without(rows: DataFrame, gone: DataFrame, key: str, gone_key: str, same: Callable[[DataFrame], Column]) -> DataFrame:
    """``rows`` without those that have a match in ``gone`` by the condition ``same(rows)``, which equates the keys.

    Rows whose key has no hash in common with a key of ``gone`` stay where
    they are; only the others are shuffled for the anti join. Null keys stay.
    """
    place = fresh([*rows.columns, *gone.columns], "place")
    hit = fresh([*rows.columns, *gone.columns, place], "hit")
    sieve = gone.select(sieve_place(gone_key).alias(place)).distinct().withColumn(hit, F.lit(True))
    marked = rows.withColumn(place, sieve_place(key)).join(F.broadcast(sieve), place, "left")
    sure, open_ = marked.filter(F.col(hit).isNull()).select(rows.columns), marked.filter(F.col(hit).isNotNull()).select(rows.columns)
    flag = fresh([*rows.columns, *gone.columns, place, hit], "flag")
    matched = open_.join(gone.distinct().withColumn(flag, F.lit(True)), same(open_), "left")  # an anti join would be moved below the sieve
    return sure.unionByName(matched.filter(F.col(flag).isNull()).select(rows.columns))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
