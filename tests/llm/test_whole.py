"""Operators do the whole job on inputs that a cap would cut."""

import pytest

from provenia.llm import ctw, near_dups
from tests.llm.test_operators import _naive_ctw


def test_ctw_keeps_contexts_seen_once_in_a_large_corpus(spark):
    train = ["ab " * 180_000, "quiz of the jovial fox"]
    fitted = ctw.fit(spark.createDataFrame([(t,) for t in train], "text string"), depth=1)
    naive = _naive_ctw(train, 1)
    asked = ["quiz of the fox", "jovial ab", "zyx", ""]
    got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), fitted).collect()}
    for i, t in enumerate(asked):
        assert got[i] == pytest.approx(naive(t), abs=1e-4)


def test_near_dups_finds_pairs_in_a_crowd_below_the_threshold(spark):
    """240 documents at a similarity of 0.77; each even one has a partner at 0.82."""
    rows = []
    for i in range(240):
        words = [f"base{k}" for k in range(261)] + [f"pair{i // 2}x{k}" for k in range(9)] + [f"own{i}x{k}" for k in range(30)]
        rows.append((i, " ".join(words)))
    out = near_dups.group(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: i - i % 2 for i in range(240)}
