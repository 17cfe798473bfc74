"""Rows that share an id, but not a text, are decided one by one."""

import random

import corpus_pipeline
from gridtide.llm.exact_dedup import drop_exact_duplicates
from test_llm_operators import words


def test_a_unique_text_stays_under_a_repeated_id(spark):
    rows = [(3, "a", "x"), (5, "a", "x"), (5, "unique", "x"), (5, " unique", "y"), (6, "a ", "x"), (6, "z", "x"), (6, "z", "y"), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    found = sorted((r["doc_id"], r["text"] or "") for r in kept.collect())
    assert found == [(5, " unique"), (5, "unique"), (6, "a "), (6, "z"), (7, "")]


def test_near_duplicates_are_decided_by_text(spark):
    rng = random.Random(8)
    texts = [words(rng, 60) for _ in range(6)]
    near = [t + " tail" for t in texts]
    rows = [(3, texts[0]), (5, near[0]), (5, texts[1]), (6, near[1]), (6, texts[2]), (7, texts[3]), (7, texts[3]), (-8, texts[4]), (9, texts[4]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, note string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([(3, texts[0]), (5, texts[1]), (6, texts[2]), (7, texts[3]), (7, texts[3]), (-8, texts[4]), (None, texts[0])], key=str)
