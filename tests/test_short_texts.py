"""Queries over texts of a few characters."""

from __future__ import annotations


def test_claims_of_short_texts_have_their_problems(spark, tmp_path):
    """texts of one or two characters, empty ones and nulls."""
    from letterspark.more_queries import QUERIES

    rows = [(55, "A."), (35, ""), (11, None), (70, "B"), (385, "long enough")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted((r.doc_id, r.claim_id, r.problem) for r in QUERIES["h8_claim_problems"](spark, str(tmp_path)).collect())
    assert found == [(11, "c3", "type"), (55, "c1", "span"), (55, "c3", "type"), (70, "c1", "span"), (385, "c1", "span"), (385, "c2", "text"), (385, "c3", "type")]
