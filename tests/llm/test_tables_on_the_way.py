"""Tables that a decision was made with don't stay on disk once it is written."""

import pytest
from corpus_pipeline import exact_duplicates, near_duplicates
from gridtide.llm import runtime

TEXT = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize("more, left", [([], ["dropped"]), ([(2, "quite different words stand here")], ["dropped", "numbered", "rows"])])
def test_near_duplicates_leave_their_decision_only(spark, tmp_path, monkeypatch, more, left):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    rows = [(k, TEXT) for k in range(1, 4)] + [(9, "another text of some words")] + more
    kept = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(p.name for p in tmp_path.glob("gridtide-*/*")) == left
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, *(x[0] for x in more), 9]


def test_exact_duplicates_leave_their_decision_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    kept = exact_duplicates(spark, spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string"), "")
    assert [p.name for p in tmp_path.glob("gridtide-*/*")] == ["decided"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_tables_of_a_settled_table_go_with_the_outer_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    inner = lambda: runtime.settled(lambda: runtime.write_table(spark.range(3), "first"), "second")
    assert runtime.settled(inner, "third").count() == 3
    assert [p.name for p in tmp_path.glob("gridtide-*/*")] == ["third"]
