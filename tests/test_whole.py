"""Queries do the whole job on rows that a cap would cut."""

from provenia.plans import registry


def test_merkle_redaction_covers_documents_of_any_length(spark, tmp_path):
    texts = [(1, "One part."), (2, " ".join(f"Part number {i} of the text." for i in range(65))), (3, " ".join(f"Part number {i} of the text." for i in range(17_000)))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["source_id"]: r for r in registry.QUERIES["merkle_redact_invariant"](spark, str(tmp_path)).collect()}
    assert set(rows) == {1, 2, 3}
    assert all(r["root"] and r["root_kept"] and r["proof_ok"] for r in rows.values())
    assert rows[3]["hidden"] == 17_000
