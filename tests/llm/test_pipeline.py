"""The pipeline's stages, each on its own input, against brute force."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_near, check_packing, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, note string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with junk, exact and near copies, and the labels of some."""
    rng, out = random.Random(4), str(tmp_path_factory.mktemp("corpus"))
    texts = [words(rng, rng.randint(20, 80)) + "." for _ in range(90)]
    rows = [(k, t, "en", f"src{k % 3}", len(t), "x") for k, t in enumerate(texts)]
    rows += [(200 + k, "BUY!! NOW!! " * (10 + k), "en", "src0", 1, None) for k in range(60)]
    rows += [(300 + k, texts[k].replace(" ", "  "), "en", "src1", 1, None) for k in range(10)]
    rows += [(400 + k, texts[20 + k] + " tail.", "en", None, 1, None) for k in range(10)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(0, 90, 2)] + [(200 + k, 0) for k in range(0, 60, 2)], "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_duplicates", "near_duplicates", "mix_sources", "pack_sequences"]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    good = stages["quality"](spark, docs, folder)
    assert good.columns == docs.columns and ids(good) == [k for k in ids(docs) if not 200 <= k < 300]
    once = stages["exact_duplicates"](spark, good, folder)
    assert once.columns == docs.columns and ids(once) == [k for k in ids(good) if k >= 10]  # the copies are longer
    near = stages["near_duplicates"](spark, once, folder)
    rows = [tuple(r) for r in once.collect()]
    least = brute_near([r[:5] for r in rows], 5, 80)[1]
    assert near.columns == docs.columns and ids(near) == sorted(k for k in least if least[k] == k) and len(ids(near)) < len(rows)
    mixed = stages["mix_sources"](spark, near, folder)
    times = Counter(ids(mixed))
    assert mixed.columns == docs.columns and set(times) <= set(ids(near)) and max(times.values()) == 2
    size = F.sum(F.regexp_count("text", F.lit("[^ ]+")))
    before, after = near.agg(size).first()[0], mixed.agg(size).first()[0]
    assert abs(after - 1.5 * before) < 4 * 80
    packed = stages["pack_sequences"](spark, mixed, folder).collect()
    check_packing(packed, [tuple(r) for r in mixed.collect()], 2048, 0)


def test_whole_run_and_registration(spark, folder):
    import __spark_entry__ as e

    found = e.queries()["pipeline"](spark, folder).collect()
    assert found and {"doc_id", "piece", "sequence_id", "offset"} <= set(found[0].asDict())
    assert "pipeline" not in e.oracle_sql()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in e.queries())] == []


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
