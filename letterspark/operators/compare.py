"""Two runs, paths or versions of the same rows side by side; features of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterspark.plans.shared import parts


def parity(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of two paths by whether they agree, differ or stand on one side only."""
    both = a.select(key, F.col(value).alias("va"), F.lit(True).alias("ina")).join(b.select(key, F.col(value).alias("vb"), F.lit(True).alias("inb")), key, "full_outer")
    state = F.when(F.col("inb").isNull(), "only a").when(F.col("ina").isNull(), "only b").when(F.col("va").eqNullSafe(F.col("vb")), "same").otherwise("differs")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def transitions(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Counts and mean change of score by band before and after."""
    rows = before.select(key, F.col("band").alias("band_before"), F.col("score").alias("s0")).join(after.select(key, F.col("band").alias("band_after"), F.col("score").alias("s1")), key)
    return rows.groupBy("band_before", "band_after").agg(F.count("*").alias("n"), F.round(F.avg(F.col("s1") - F.col("s0")), 6).alias("mean_change"))


def distribution(df: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Number, mean and largest score for all, by each key and by both."""
    g = df.cube(a, b).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.max(score).alias("largest"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    return g.select(F.when(F.col("ga") == 1, "all").otherwise(F.col(a)).alias(a), F.when(F.col("gb") == 1, "all").otherwise(F.col(b)).alias(b), "n", "mean_score", "largest")


def flat_features(ledger: DataFrame, rules: list[str], key: str = "msg_id") -> DataFrame:
    """A flag for each rule that found a contradiction, the worst severity, and counts of findings."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    flags = [F.max(F.when(F.col("contradiction") & (F.col("rule") == r), 1).otherwise(0)).alias(f"rule_{r}") for r in rules]
    return ledger.groupBy(key).agg(*flags, F.max(rank).alias("worst"), F.count("contradiction").alias("n_checked"), F.count_if("contradiction").alias("n_contradicted"))


def novelty(df: DataFrame, by: str, kind: str, position: str) -> DataFrame:
    """Where each kind is first seen in its group."""
    return df.groupBy(by, kind).agg(F.min(position).alias("first"))


def digits_mod(digits: Column, m: int) -> Column:
    """A decimal string of any length modulo ``m``."""
    return F.aggregate(F.filter(F.split(digits, ""), lambda d: d != ""), F.lit(0), lambda acc, d: (acc * 10 + d.cast("int")) % m)


def account_number(country: str, number: Column) -> Column:
    """A fictional account number whose check digits hold: country, two check digits, digits."""
    code = "".join(str(ord(c) - 55) for c in country)
    check = F.lit(98) - digits_mod(F.concat(number, F.lit(code + "00")), 97)
    return F.concat(F.lit(country), F.lpad(check.cast("string"), 2, "0"), number)


def valid_account_number(value: Column) -> Column:
    """Shape and remainder of an account number of 15 to 34 characters, spaces apart."""
    bare = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    digit = lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)
    digits = F.array_join(F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), digit), "")
    return F.when(bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), digits_mod(digits, 97) == 1).otherwise(False)


def feature_vectors(messages: DataFrame, ledger: DataFrame, rules: list[str], verifiers: list[str], probabilities: DataFrame, tactics: list[str], coverage: DataFrame, key: str = "msg_id") -> DataFrame:
    """A flat vector for each of ``messages``: flags of rules that found a contradiction, the worst of each verifier (0 to 3), a probability a tactic, claims found and checked.

    ``probabilities``: (key, tactic, p); ``coverage``: (key, claims, checked). What a message has no row for is 0. ``features``
    holds the same columns in their order, ready for ``array_to_vector``. Rows are dealt by message in bounded parts, as in ``coverage_report``.
    """
    n = parts(ledger)
    hit = F.coalesce("contradiction", F.lit(False))
    rank = F.when(hit, F.array_position(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("severity"))).otherwise(0)
    flags = [F.max(F.when(hit & (F.col("rule") == r), 1).otherwise(0)).alias(f"rule_{r}") for r in rules]
    worst = [F.max(F.when(F.col("verifier") == v, rank).otherwise(0)).cast("int").alias(f"worst_{v}") for v in verifiers]
    chances = probabilities.select(key, "tactic", "p").repartition(n, key).groupBy(key).agg(*(F.max(F.when(F.col("tactic") == x, F.col("p"))).alias(f"tactic_{x}") for x in tactics))
    found = coverage.select(key, F.col("claims").alias("claims_found"), F.col("checked").alias("claims_checked"))
    own = ledger.select(key, "verifier", "rule", "contradiction", "severity").repartition(n, key).groupBy(key).agg(*flags, *worst)
    out = messages.select(key).repartition(n, key).distinct().join(own, key, "left").join(chances, key, "left").join(found, key, "left")
    names = [c for c in out.columns if c != key]
    return out.fillna(0, names).withColumn("features", F.array(*(F.col(c).cast("double") for c in names)))
