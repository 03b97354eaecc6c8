"""The world table: one row a message with its facts, claims, verdicts and vectors, from tables bucketed by message.

Each part is one row a message and is written once in buckets of the message's id; parts of equal buckets join bucket by
bucket, so adding a part shuffles that part alone, whatever the others hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterspark.operators.claim_phrases import STRONG
from letterspark.operators.claims import TYPES
from letterspark.plans.shared import bucketed

# States of a check, and what a verdict says.
STATES = ("pass", "fail", "none", "unknown")
BUCKETS = ("contradiction", "consistent", "not_checkable")


def verdict_bucket(contradiction: Column) -> Column:
    """What a verdict says: contradiction, consistent or, where it is NULL, not_checkable."""
    return F.when(contradiction.isNull(), BUCKETS[2]).when(contradiction, BUCKETS[0]).otherwise(BUCKETS[1])


def text_vector(claims: DataFrame, key: str = "msg_id") -> DataFrame:
    """Counts of a message's claims: all, strong ones, and by type."""
    kinds = [F.count_if(F.col("type") == k).alias(f"n_{k}") for k in TYPES]
    return claims.groupBy(key).agg(F.count("*").alias("n_claims"), F.count_if(F.col("confidence") >= STRONG).alias("n_strong"), *kinds)


def header_vector(evidence: DataFrame, key: str = "id") -> DataFrame:
    """States of the three checks as flags (others count as fail), and each three-valued fact as two flags: true, and known."""
    flags = {}
    for method in ("spf", "dkim", "dmarc"):
        state = F.when(F.col(method).isin("pass", "none", "unknown"), F.col(method)).otherwise("fail")
        flags |= {f"{method}_{s}": (state == s).cast("int") for s in STATES}
    for fact in ("auth_aligned", "freemail", "name_has_address", "list_mail", "reply_to_divergence", "envelope_mismatch", "from_matches_org"):
        flags |= {fact: F.coalesce(F.col(fact), F.lit(False)).cast("int"), f"{fact}_known": F.col(fact).isNotNull().cast("int")}
    return evidence.select(key, *(v.alias(k) for k, v in flags.items()))


def ledger_vector(ledger: DataFrame, verifiers: list[str], key: str = "msg_id") -> DataFrame:
    """Counts of verdicts of each verifier by what they say."""
    said = verdict_bucket(F.col("contradiction"))
    return ledger.groupBy(key).agg(*(F.count_if((F.col("verifier") == v) & (said == b)).alias(f"{v}_{b}") for v in verifiers for b in BUCKETS))


def world(facts: DataFrame, parts: list[DataFrame], key: str = "msg_id", buckets: int | None = None) -> DataFrame:
    """``facts`` with the columns of all parts; counts that a message has no row for are 0.

    ``buckets``: as many as the session's shuffle partitions unless given.
    """
    n = buckets or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = [bucketed(x, key, n) for x in (facts, *parts)]
    counts = [c for p in parts for c in p.columns if c != key]
    return reduce(lambda a, b: a.join(b.hint("merge"), key, "left"), tables).fillna(0, counts)
