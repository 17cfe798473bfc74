"""What is lost, doubled or damaged between writing and reading archives is reported."""

from gridtide.llm import runtime, warc
from pyspark.sql import functions as F


def test_losses_between_writing_and_reading(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * (k % 5)) for k in range(60)] + [(7, "http://h/7", "<p>7</p><p>7</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert {r["intact"] for r in warc.fixity(pages).collect()} == {True}
    manifest, archives = warc.write_manifest(pages), warc.write_bytes(pages)
    data = bytes(archives.first()["data"])
    records = [r for _, r in warc.split_archive(data)]
    assert len(records) == len(rows) and b"".join(records) == data
    hurt = list(records)
    hurt[40] = hurt[40].replace(b"Content-Length: 0", b"Content-Length: 9")  # no such length
    hurt[33] = hurt[33].replace(b"<p>33", b"<p>34")
    hurt = hurt[:5] + hurt[6:21] + hurt[20:]
    bad = spark.createDataFrame([(0, 0, bytearray(b"".join(hurt)))], archives.schema)
    found = warc.report(manifest, warc.read_back(bad)).collect()
    got = sorted((r["id"] is None, r["id"], r["status"]) for r in found if r["status"] not in ("intact", "extra"))
    assert got == [(False, 5, "missing"), (False, 33, "corrupt"), (False, 40, "missing")]
    extra = [r for r in found if r["status"] == "extra"]  # the doubled record and what has no readable length
    assert len(extra) == 2 and all(r["id"] is None and r["n_bytes"] for r in extra)
    assert sum(r["status"] == "intact" for r in found) == len(rows) - 3


def test_a_lost_archive_is_seen_by_the_query(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "x") for k in range(20)], "page_id long, url string, html string").repartition(2)
    write = runtime.write_table
    monkeypatch.setattr(runtime, "write_table", lambda df, name: write(df.filter(F.col("archive") == 1) if name == "archive" else df, name))
    found = warc.fixity(pages).collect()
    lost = [r for r in found if not r["intact"]]
    assert len(found) == 20 and 0 < len(lost) < 20 and all(r["n_bytes"] is None for r in lost)
