"""Phrases are searched only where their words stand, with the same result, and claims that are read several times are made once."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators import claims as H
from letterspark.plans.shared import spread

TEXTS = ("I AM the CEO. As we discussed, verify all your account details", "significant login; catalog of cards", "Gift Cards, gift  card\ngiftcard", "pay 10 dollars, Transfer 5 euros", "our HR department; our team", "İ sign in K", "", None, "Write to me only, Tel: +49 30 1234567, best regards, Ann Lee", "our new bank account number")


def _texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")


def test_words_of_a_phrase_are_looked_for_before_it(spark):
    """the search of each phrase stands behind a cheap condition that holds for each text with a match."""
    rows = _texts(spark)
    plan = rows.select(H.phrase_candidates(F.col("text")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") >= len(H.SHORT_PATTERNS)
    for p in H.SHORT_PATTERNS:
        searched = F.size(H.places(F.col("text"), H.compile_phrase(p[2])))
        got = rows.select("k", H.may_match(F.lower("text"), p[2]).alias("may"), searched.alias("n"), F.size(F.filter(H.phrase_candidates(F.col("text")), lambda c: c["pattern"] == p[0])).alias("found"))
        assert all((r.n or 0) <= 0 or r.may for r in got.collect()), p
        assert all(r.n == r.found for r in got.where("k <> 7").collect()), p


def test_claims_are_made_once_for_their_scores(spark):
    claims = _texts(spark).where("text is not null").select(F.col("k").alias("doc_id"), F.lit("gift_card").alias("type"), F.regexp_replace("text", "once-only", "").alias("claim"), F.lit("c1").alias("claim_id"))
    labels = spark.createDataFrame([(2, "gift_card", "gift cards", "l1")], "doc_id long, type string, span string, label_id string")
    found = H.span_scores(labels, claims)
    assert "once-only" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.found, r.right, r.met) for r in found.collect()] == [(9, 1, 1)]


def test_small_tables_are_dealt_to_all_cores(spark):
    one = spark.range(10).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread(one).collect()) == list(range(10))
