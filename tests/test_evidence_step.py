"""The steps of the evidence query: brands found in the row, and only what the rows explained rest on."""

from pyspark.sql import functions as F

from letterspark.operators import lexicon as P
from letterspark.operators import rules as R


def test_first_phrase_in_the_row(spark):
    names = spark.createDataFrame([("sender group", "s"), ("sender", "x"), ("paypal", "p"), ("pay", "q"), ("paypal", "z"), ("", "none")], "phrase string, brand string")
    texts = ["Sender Group and PayPal", "a sender; grouped", "PAYPAL, pay", "paypals payment", "", None, "to pay the sender group"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = P.with_first_phrase(rows, names, "text", "brand")
    assert [r.brand for r in found.orderBy("id").collect()] == ["s", "x", "p", None, None, None, "q"]
    none = P.with_first_phrase(rows, names.where("false"), "text", "brand")
    assert [r.brand for r in none.collect()] == [None] * 7


def test_evidence_needs_no_columns_of_other_rules(spark):
    claims = spark.createDataFrame([(1, "a", "authority", 0.9, None), (1, "b", "gift_card", 0.9, "lookalike"), (1, "c", "signature_contact", 0.9, None), (1, "d", "prior_relationship", 0.9, None)], "msg_id long, claim_id string, type string, confidence double, brand_relation string")
    no, text = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    facts = spark.createDataFrame([(1,)], "msg_id long").select(
        "msg_id", F.lit("x.com").alias("from_registered"), text.alias("reply_domain"), text.alias("org_relation"), F.lit("failed").alias("auth_state"), *(no.alias(c) for c in ("freemail", "external", "from_matches_org", "reply_to_divergence", "name_address", "name_domain"))
    )
    rows = {r.claim_id: (r.rule, r.severity) for r in R.evidence(claims, facts).collect()}
    assert rows == {"a": ("hv_auth_dmarc_fail", "high"), "b": ("rv_lookalike", "high")}
