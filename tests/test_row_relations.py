"""Relations judged in their own row are those of the join, at any likeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators import domains as D
from letterspark.operators import rules as R


def test_relations_of_a_row_need_no_shuffle(spark):
    rows = [(1, "paypal.com", ["paypa1.com", "paypal.de"]), (2, "sender.com", ["sendar.com"]), (3, "a.de", ["a.de", "a.fr"]), (4, "acme.com", []), (5, None, ["a.de"]), (6, "acme.com", None), (7, "abcdefgh.com", ["badcfehg.de"]), (8, "a.fr", ["a.de"])]
    df = spark.createDataFrame(rows, "k long, d string, t array<string>")
    got = df.select("k", R.strongest_relation(F.col("d"), F.col("t")).alias("relation"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    joined = R.best_relation(df, df.select("k", F.explode("t").alias("target")), ["k"], "d").select("k", "relation")
    expected = {r.k: r.relation for r in joined.collect()}
    assert {r.k: r.relation for r in got.collect()} == {k: expected.get(k) for k in range(1, 9)}


def test_bounds_agree_with_exact_likeness(spark):
    names = ["abcdef", "abcdeg", "abcdefgh", "badcfehg", "sender", "senders", "sendar", "resend", "microsoft", "microsofft", "mircosoft", "xmicrosoftx", "walmart", "wallmarts", "paypalsecure", "paypal-secure"]
    one = spark.createDataFrame([(n,) for n in names], "n string")
    pairs = one.crossJoin(one.select(F.col("n").alias("m")))
    x, y = D.skeleton(F.col("n")), D.skeleton(F.col("m"))
    exact = (x == y) | ((F.least(F.length("n"), F.length("m")) >= 6) & (D._ratio(x, y) >= 80.0))
    assert not pairs.where(D.names_alike(F.col("n"), F.col("m")) != exact).count()
