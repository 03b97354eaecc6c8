"""Coverage reports, flat vectors, scored cases and false alarms on small ledgers."""

from __future__ import annotations

import pytest

from letterspark.operators import compare as X
from letterspark.operators import scoring as K
from letterspark.operators import threads as J

LEDGER = "msg_id int, claim_id string, claim_type string, verifier string, rule string, contradiction boolean, severity string"
ROWS = [
    (1, "c1", "authority", "header", "r1", True, "high"), (1, "c1", "authority", "thread", "t1", False, "none"), (1, "c2", "payment_request", "request", "r2", None, "not_checkable"),
    (1, "c9", "payment_request", "request", "r2", True, "low"), (1, "thread", "single_email", "thread", "t2", None, "not_checkable"), (1, "thread", "sending_path", "thread", "t3", True, "medium"),
    (2, "c1", "authority", "header", "r1", False, "none"), (2, "thread", "sending_path", "thread", "t3", None, "not_checkable"), (4, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame(ROWS, LEDGER)


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "z")], "msg_id int, claims string")


def report(spark, ledger, messages):
    claims = spark.createDataFrame([(1, "c1"), (1, "c2"), (1, "c1"), (2, "c1"), (3, "c1")], "msg_id int, claim_id string")
    limits = spark.createDataFrame([(1, "no_from"), (1, "no_from"), (1, "odd"), (3, "single_email"), (3, None)], "msg_id int, code string")
    return K.coverage_report(messages, ledger, claims, limits)


def test_coverage_report(spark, ledger, messages):
    found = {r.msg_id: r for r in report(spark, ledger, messages).collect()}
    assert tuple(found[1])[1:9] == (2, 1, 1, 0, 1, 2, 1, 1) and found[1].limits == ["no_from"]
    assert found[1].note == "1 of 2 claims could be checked. 1 of 1 checks against the thread ran. There was no usable sender."
    assert found[2].note == "1 of 1 claims could be checked. 0 of 1 checks against the thread ran." and found[2].consistent == 1
    assert found[3].note == "No claim that can be checked was found. There was no earlier message to compare with." and found[3].claims == 0 and len(found) == 3
    assert report(spark, ledger, messages.limit(0)).count() == 0


def test_flat_vectors(spark, ledger, messages):
    chances = spark.createDataFrame([(1, "urgency", 0.25), (2, "other", 0.5), (3, "urgency", None)], "msg_id int, tactic string, p double")
    found = X.feature_vectors(messages, ledger, ["r1", "r2", "t3"], ["header", "request", "thread"], chances, ["urgency"], report(spark, ledger, messages))
    assert {r.msg_id: r.features for r in found.collect()} == {1: [1, 1, 1, 3, 1, 2, 0.25, 2, 1], 2: [0, 0, 0, 0, 0, 0, 0, 1, 1], 3: [0.0] * 9}


def test_cases_with_and_without_a_verifier(spark, ledger):
    cases = spark.createDataFrame([(1, "t1", "test", "A", 1), (2, "t1", "test", "B", 1), (3, "t2", "test", "neg", 0)], "msg_id int, thread string, split string, variant string, label int")
    detail = K.scored_both(cases, ledger)
    assert {r.msg_id: (r.score_full, r.score_without, r.band_full, r.band_without) for r in detail.collect()} == {1: (79, 63, "high", "medium"), 2: (0, 0, "low", "low"), 3: (0, 0, "low", "low")}
    table = {(r.variant, r.metric): (r.n, r.hits, r.rate, r.low, r.high) for r in K.case_table(detail, ["split"], "thread", 50).collect()}
    assert len(table) == 16 and table["attacks", "some_full"] == (2, 1, 0.5, 0.5, 0.5) and table["attacks", "high_without"][:3] == (2, 0, 0.0) and table["neg", "some_full"][:3] == (1, 0, 0.0)


def test_false_alarms(spark):
    schema = "msg_key string, thread_id int, position int, claim_type string, rule string, contradiction boolean, severity string"
    rows = [("a1", 1, 1, "single_email", "s", True, "medium")]
    rows += [(f"a{k}", 1, k, "sending_path", "p", k == 3, "high" if k == 3 else "none") for k in (2, 3)] + [("a3", 1, 3, "thread_integrity", "q", True, "low"), ("a3", 1, 3, "thread_integrity", "q2", True, "medium")]
    rows += [("b1", 2, 1, "single_email", "s", None, "not_checkable"), ("b2", 2, 2, "sending_path", "p", None, "not_checkable"), ("c1", 3, 1, "single_email", "s", False, "none")]
    ledger = spark.createDataFrame(rows, schema)
    threads = spark.createDataFrame([(1, "test", "x"), (2, "test", "x"), (3, "test", "x")], "thread_id int, split string, source string")
    rates = J.thread_rates(ledger, threads).first().asDict()
    assert rates == {"split": "test", "source": "x", "messages": 6, "judged": 3, "flagged_messages": 1, "high_messages": 1, "threads": 3, "flagged_threads": 1, "flips": 1}
    summary, rules = J.false_alarms(ledger, threads, 200)
    s = summary.first()
    assert (s.threads, s.messages, s.flagged, s.rate) == (2, 3, 1, 0.333333) and s.low == 0.0 and s.high == 0.5 and s.wilson_low < s.rate < s.wilson_high
    assert {(r.rule, r.signal, r.messages_flagged, r.messages) for r in rules.collect()} == {("p", "sending_path", 1, 3), ("q2", "thread_integrity", 1, 3)}
    assert J.false_alarms(ledger.limit(0), threads, 10)[1].count() == 0
