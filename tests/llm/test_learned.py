"""The learned queries against plain fits of their own, and on documents that they never saw."""

import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from gridtide.llm import quality
from gridtide.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def plain_bradley_terry(good, bad, ridge, steps=4000):
    """Gradient descent over every pair of a better row and a worse one."""
    w = [0.0] * len(good[0])
    diffs = [[a - b for a, b in zip(g, h, strict=True)] for g in good for h in bad]
    for k in range(steps):
        pull = [ridge * x for x in w]
        for d in diffs:
            wrong = 1 / (1 + math.exp(sum(a * b for a, b in zip(d, w, strict=True))))
            pull = [p - wrong * x / len(diffs) for p, x in zip(pull, d, strict=True)]
        w = [x - p * (1.0 if k < steps // 2 else 0.3) for x, p in zip(w, pull, strict=True)]
    return w


def test_weights_equal_a_plain_fit():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(14, 3))
    good = x @ [1.0, -0.5, 0.0] + draw.normal(size=14) > 0
    z = (x - x.mean(0)) / x.std(0)
    found = quality.fit_ranking(x, good, ridge=0.05)
    assert found.weights == pytest.approx(plain_bradley_terry(z[good].tolist(), z[~good].tolist(), 0.05), abs=1e-6)
    worth = z @ found.weights
    right = lambda cut: sum((a >= cut) == b for a, b in zip(worth, good, strict=True))
    assert right(found.threshold) == max(right(cut) for cut in worth)
    assert found.score(x) == pytest.approx([1 / (1 + math.exp(found.threshold - a)) for a in worth])


def test_the_score_keeps_the_order_of_worth_and_ties():
    x = np.array([[0.0, 1.0], [1.0, 1.0], [2.0, 1.0], [2.0, 1.0]])
    score = quality.fit_ranking(x, np.array([False, False, True, True])).score(x)
    assert score[0] < score[1] < 0.5 <= score[2] == score[3]


def test_quality_of_documents_that_were_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist() if r["quality"] is not None}
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    found = {r["doc_id"]: r for r in QUERIES["op3_bradley_terry_quality"](spark, DATA).collect()}
    assert found.keys() == texts.keys() and all(r["held_out"] == (fold(k, 3) == 1) and r["predicted"] == (r["score"] >= 0.5) for k, r in found.items())
    learned = sorted(k for k in labels if k in texts and fold(k, 3) != 1)
    x = np.array([quality.text_features(texts[k]) for k in learned])
    own = quality.fit_ranking(x, np.array([labels[k] == 1 for k in learned]))
    assert [found[k]["score"] for k in texts] == pytest.approx(own.score(np.array([quality.text_features(t) for t in texts.values()])).tolist(), abs=1e-9)
    held = [k for k in labels if k in texts and fold(k, 3) == 1]
    assert held and sum(found[k]["predicted"] == labels[k] for k in held) >= 0.95 * len(held)


def test_language_of_documents_that_were_held_out(spark):
    rows = {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()}
    found = {r["doc_id"]: r for r in QUERIES["op5_backoff_language_id"](spark, DATA).collect()}
    assert found.keys() == rows.keys() and all(r["held_out"] == (fold(k, 4) == 2) for k, r in found.items())
    unsaid = {k for k, r in rows.items() if not any(c.isalpha() for c in r["text"] or "")}
    assert unsaid == {k for k, r in found.items() if r["lang_pred"] == "und"}
    held = [k for k, r in rows.items() if r["lang"] and fold(k, 4) == 2 and k not in unsaid]
    assert held and sum(found[k]["lang_pred"] == rows[k]["lang"] for k in held) >= 0.97 * len(held)
