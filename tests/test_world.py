"""The world table: parts join without a shuffle; header flags by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators import headers as E
from letterspark.operators import world as Y


def test_parts_join_without_an_exchange(spark):
    facts = spark.range(50).select(F.col("id").alias("msg_id"), F.lit("x").alias("source"))
    claims = spark.createDataFrame([(1, "authority", 0.9), (1, "gift_card", 0.6), (7, "authority", 0.9), (99, "authority", 0.9)], "msg_id long, type string, confidence double")
    ledger = spark.createDataFrame([(1, "header", True), (1, "header", None), (3, "request", False)], "msg_id long, verifier string, contradiction boolean")
    out = Y.world(facts, [Y.text_vector(claims), Y.ledger_vector(ledger, ["header", "request"])], buckets=4)
    rows = {r.msg_id: r for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert len(rows) == 50 and (rows[1].n_claims, rows[1].n_strong, rows[1].n_gift_card, rows[1].header_contradiction, rows[1].header_not_checkable) == (2, 1, 1, 1, 1)
    assert rows[3].request_consistent == 1 and rows[5].n_claims == rows[5].header_contradiction == 0


def test_header_flags(spark):
    raw = "From: a@sender.com\nAuthentication-Results: mx.acme.co.uk; spf=softfail smtp.mailfrom=sender.com; dkim=pass header.d=sender.com\nTo: b@acme.co.uk"
    r = Y.header_vector(E.evidence(spark.createDataFrame([(1, raw)], "id int, raw_headers string"))).first()
    assert (r.spf_fail, r.dkim_pass, r.dmarc_unknown, r.spf_pass) == (1, 1, 1, 0)
    assert (r.auth_aligned, r.auth_aligned_known, r.envelope_mismatch, r.envelope_mismatch_known, r.freemail_known) == (1, 1, 0, 0, 1)
