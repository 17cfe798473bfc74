"""The bounded sample that languages are learned from keeps the rare ones."""

import random

from gridtide.llm import langid

DOCS = "doc_id long, text string, lang string"


def test_a_rare_language_is_learned_at_any_size(spark):
    rng = random.Random(2)
    make = lambda a: " ".join("".join(rng.choices(a, k=5)) for _ in range(12))
    rows = [(k, make("abcd"), "aa") for k in range(4000)] + [(10_000 + k, make("wxyz"), "bb") for k in range(4)] + [(20_000 + k, make("klmn"), "cc") for k in range(300)]
    found = langid.identify_language(spark.createDataFrame(rows, DOCS), fold=1, folds=1, max_docs=100).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in found}
    assert len(got) == len(rows) and all(got[k] == lang for k, _, lang in rows)


def test_fair_share():
    assert langid.fair_share([], 10) is None and langid.fair_share([(5, 2)], 10) is None
    assert langid.fair_share([(6, 2)], 10) == 5 and langid.fair_share([(4000, 1), (4, 1), (300, 1)], 100) == 48
    assert langid.fair_share([(7, 50)], 10) == 1
