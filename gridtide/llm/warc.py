"""WARC archives and their fixity audit by Merkle trees.

Pages become WARC records; each write task makes one archive, in the order of
its rows. An archive's records are hashed with their offset ranges, and
``FAN_OUT`` consecutive hashes make a node of the next level, up to one root.
An audit compares the roots of two replicas and descends into branches
that differ only, down to the records.

Two tables are made of the pages, each by itself: a manifest (what each record
should be) and the archives' bytes. The audited side is parsed from these bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pieces, runtime

FAN_OUT = 16
RECORD_DATE = "1970-01-01T00:00:00Z"
#: An archive is stored in segments of whole records, closed at so many bytes.
SEGMENT_BYTES = 1 << 20
_MAGIC, _END = b"WARC/1.0\r\n", b"\r\n\r\n"


def uuid_of(page_id: Column) -> Column:
    key = F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"))
    return F.concat_ws("-", *(F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def record_of(page_id: Column, url: Column, html: Column, date: str = RECORD_DATE) -> Column:
    """A WARC/1.0 resource record as text; nulls count as empty, line ends in a URL are percent-encoded."""
    body = F.coalesce(html, F.lit(""))
    where = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid_of(page_id),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), where,
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def _records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    record = record_of(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return pages.select(F.col(id_col).alias("id"), F.spark_partition_id().alias("archive"), (F.monotonically_increasing_id() % (1 << 33)).alias("seq"), record.alias("record"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the records to the shared folder: ``id, archive, seq, record`` and ``noted``, their SHA-256 when made."""
    rows = _records(pages, id_col, url_col, html_col)
    return runtime.write_table(rows.select("id", "archive", "seq", "record", F.sha2("record", 256).alias("noted")), "archive")


def write_manifest(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What each record should be: ``id, uuid, archive, seq, length, digest``."""
    rows = _records(pages, id_col, url_col, html_col)
    rows = rows.select("id", uuid_of(F.col("id")).alias("uuid"), "archive", "seq", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    return runtime.write_table(rows, "manifest")


def write_bytes(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = SEGMENT_BYTES) -> DataFrame:
    """Write the archives' bytes in order: ``archive, segment, data``; a segment is numbered by its first record."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive], pa.int32()), pa.array([first], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["archive", "segment", "data"])

        held, size, archive, first = [], 0, 0, 0
        for batch in batches:
            for own, seq, record in zip(*batch.columns, strict=True):
                if not held:
                    archive, first = own.as_py(), seq.as_py()
                held.append(record.as_py())
                size += len(held[-1])
                if size >= most:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    rows = _records(pages, id_col, url_col, html_col).select("archive", "seq", F.col("record").cast("binary"))
    return runtime.write_table(rows.mapInArrow(pieces.tidy(segments), "archive int, segment long, data binary"), "archive")


def parse_archive(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record of an archive's bytes."""
    out, at = [], 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if first != "WARC/1.0":
            raise ValueError(f"no WARC record at offset {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        end = stop + 4 + int(fields["Content-Length"])
        out.append((fields, data[stop + 4 : end]))
        at = end + 4
    return out


def split_archive(data: bytes) -> list[tuple[str, bytes]]:
    """UUID and bytes of each record, also of a damaged archive.

    Where no whole record is found, everything up to the next record's
    first line is one record; its UUID is empty.
    """
    out, at = [], 0
    while at < len(data):
        stop, uuid = -1, ""
        try:
            head = data.index(_END, at) + 4
            if data.startswith(_MAGIC, at):
                fields = dict(x.split(": ", 1) for x in data[at : head - 4].decode().split("\r\n")[1:])
                size = int(fields["Content-Length"])
                end = head + size + 4
                if size >= 0 and data[end - 4 : end] == _END and (end == len(data) or data.startswith(_MAGIC, end)):
                    ((own, _),) = parse_archive(data[at:end])
                    stop, uuid = end, own["WARC-Record-ID"].removeprefix("<urn:uuid:").removesuffix(">")
        except (KeyError, ValueError):
            pass
        if stop < 0:
            following = data.find(_END + _MAGIC, at)
            stop, uuid = len(data) if following < 0 else following + 4, ""
        out.append((uuid, data[at:stop]))
        at = stop
    return out


def read_back(archives: DataFrame) -> DataFrame:
    """``uuid, archive, seq, length, digest`` of the records parsed from archives' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, segment, data in zip(*batch.columns, strict=True):
                found = split_archive(data.as_py())
                seqs = [segment.as_py() + k for k in range(len(found))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([u for u, _ in found], pa.string()), pa.array([archive.as_py()] * len(found), pa.int32()), pa.array(seqs, pa.int64()),
                        pa.array([len(r) for _, r in found], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for _, r in found], pa.string()),
                    ],
                    names=["uuid", "archive", "seq", "length", "digest"],
                )

    rows = archives.select("archive", "segment", "data").mapInArrow(pieces.tidy(run), "uuid string, archive int, seq long, length long, digest string")
    return runtime.write_table(rows, "read_back")


def leaves(records: DataFrame) -> DataFrame:
    """``archive, seq, offset, length, hash`` from ``archive, seq, length, digest`` (hex SHA-256 of a record)."""
    order = Window.partitionBy("archive").orderBy("seq")  # an archive is what one task wrote
    rows = records.select(
        "archive", "length", "digest", (F.row_number().over(order) - 1).cast("long").alias("seq"),
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"),
    )
    return rows.select("archive", "seq", "offset", "length", F.sha2(F.concat_ws(":", F.lit("leaf"), "offset", "length", "digest"), 256).alias("hash"))


def tree(records: DataFrame, levels: int, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels of nodes ``archive, node, start, stop, hash``, leaves first; ``fan_out**levels`` records fit under a root."""
    level = leaves(records).select("archive", F.col("seq").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), "hash")
    out = [runtime.write_table(level, "level0")]
    for k in range(1, levels + 1):
        child = F.struct("node", "hash")
        up = out[-1].groupBy("archive", F.expr(f"node div {fan_out}").alias("node")).agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(child)).alias("children"),
        )
        hashes = F.array_join(F.transform("children", lambda c: c["hash"]), ":")
        up = up.select("archive", "node", "start", "stop", F.sha2(F.concat_ws(":", F.lit("node"), "start", "stop", hashes), 256).alias("hash"))
        out.append(runtime.write_table(up, f"level{k}"))
    return out


def levels_for(records: int, fan_out: int = FAN_OUT) -> int:
    """Levels over the leaves that unite so many records of an archive under one root."""
    levels, room = 0, 1
    while room < records:
        levels, room = levels + 1, room * fan_out
    return levels


def audit(first: DataFrame, second: DataFrame, fan_out: int = FAN_OUT) -> DataFrame | None:
    """Records at which two replicas (``archive, seq, length, digest``) differ; None if their roots are equal.

    Rows: ``archive, seq`` (place in the archive, from 0), ``start, stop`` (offset range in the first
    replica, else the second) and ``status``: ``corrupt``, ``missing`` (not in the second) or
    ``extra`` (not in the first). A changed length moves the offsets behind it,
    so these ranges differ as well.
    """
    counts = first.groupBy("archive").count().unionByName(second.groupBy("archive").count())
    levels = levels_for(counts.agg(F.max("count")).first()[0] or 0, fan_out)
    one, two = tree(first, levels, fan_out), tree(second, levels, fan_out)
    suspects = None
    for k in range(levels, -1, -1):
        a, b = one[k], two[k].select("archive", "node", *(F.col(c).alias(f"{c}2") for c in ("start", "stop", "hash")))
        if suspects is not None:
            above = suspects.select("archive", F.col("node").alias("parent"))
            within = lambda x: x.withColumn("parent", F.expr(f"node div {fan_out}")).join(above, ["archive", "parent"], "left_semi").drop("parent")  # noqa: B023, E731
            a, b = within(a), within(b)
        both = a.join(b, ["archive", "node"], "full_outer").filter(~F.col("hash").eqNullSafe(F.col("hash2")))
        suspects = runtime.write_table(both, f"differing{k}")
        if suspects.isEmpty():
            return None
    status = F.when(F.col("hash2").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("corrupt")
    return suspects.select("archive", F.col("node").alias("seq"), F.coalesce("start", "start2").alias("start"), F.coalesce("stop", "stop2").alias("stop"), status.alias("status"))


def _placed(rows: DataFrame) -> DataFrame:
    """With each record's place in its archive, from 0, as ``audit`` names it."""
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy("archive").orderBy("seq")) - 1).cast("long"))


def _pairs(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """Full outer join of ``was`` and ``now`` structs; the k-th left record meets the k-th right one that is equal in ``by``."""
    one, two = (x.select(F.col(c), *(F.col(f"{c}.{b}").alias(b) for b in by)) for x, c in ((left, "was"), (right, "now")))
    nth = lambda x, c: x.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(f"{c}.archive", f"{c}.seq")))
    return nth(one, "was").join(nth(two, "now"), [*by, "nth"], "full_outer").select("was", "now")


def report(manifest: DataFrame, read: DataFrame) -> DataFrame:
    """``id, status, n_bytes, record_sha256``: a row per record of the manifest, and one per extra record that was read.

    ``intact``: read with the noted length and digest. ``corrupt``: a record
    of this UUID was read, with others. ``missing``: none was; length and
    digest are null. ``extra``: read, but not noted; its id is null.
    Trees tell which records need a look. Of those, equal ones count as intact
    wherever they are, as a lost record moves all behind it.
    """
    different = audit(*(x.select("archive", "seq", "length", "digest") for x in (manifest, read)))
    intact = lambda x: x.select("id", F.lit("intact").alias("status"), F.col("length").alias("n_bytes"), F.col("digest").alias("record_sha256"))
    if different is None:
        return intact(manifest)
    look = different.select("archive", F.col("seq").alias("place"))
    noted = _placed(manifest)
    was = noted.join(look, ["archive", "place"], "left_semi").select(F.struct("id", "uuid", "archive", "seq", "length", "digest").alias("was"))
    now = _placed(read).join(look, ["archive", "place"], "left_semi").select(F.struct("uuid", "archive", "seq", "length", "digest").alias("now"))
    equal = runtime.write_table(_pairs(was, now, "length", "digest"), "equal_records")
    rest = _pairs(equal.filter("now IS NULL").select("was"), equal.filter("was IS NULL").select("now"), "uuid")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").otherwise("corrupt")
    moved = equal.filter("was IS NOT NULL AND now IS NOT NULL").select("was.id", "was.length", "was.digest")
    found = rest.select(F.col("was.id").alias("id"), status.alias("status"), F.col("now.length").alias("n_bytes"), F.col("now.digest").alias("record_sha256"))
    return intact(noted.join(look, ["archive", "place"], "left_anti")).unionByName(intact(moved)).unionByName(found)


def fixity(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive ``pages``, parse the archives' bytes and audit them against a manifest made of the pages by itself.

    One row per page: id, ``n_bytes`` and ``record_sha256`` of its record as
    read back, and ``intact``. A missing record has neither length nor digest;
    one that was read and isn't noted has a row with a null id; both
    aren't intact (``report`` names the status).

    Null ids, URLs and bodies count as empty in the record; repeated rows are
    records of their own; an empty table gives no rows; further columns are
    ignored, whatever their names.
    """
    runtime.prepare(pages.sparkSession)
    manifest = write_manifest(pages, id_col, url_col, html_col)
    rows = report(manifest, read_back(write_bytes(pages, id_col, url_col, html_col)))
    return rows.select(F.col("id").alias(id_col), "n_bytes", "record_sha256", (F.col("status") == "intact").alias("intact"))
