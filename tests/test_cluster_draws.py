"""a cluster's draws are made in one task, once for all groups and metrics."""

from pyspark.sql import functions as F

from letterspark.operators import evaluate as L


def test_groups_share_the_draws_of_a_cluster(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("thread"), (F.col("id") % 3).alias("g"), (F.col("id") % 7 == 0).cast("int").alias("hit"))
    sums, share = {"a": F.sum("hit"), "c": F.count("*")}, {"rate": F.try_divide("a", "c")}
    found = L.intervals(df, ["g"], "thread", sums, share, 40)
    assert "hashpartitioning(_h" in found._jdf.queryExecution().executedPlan().toString()  # before: by group and cluster
    got = {r.g: (r.value, r.low, r.high) for r in found.collect()}
    for g in range(3):
        alone = L.intervals(df.where(F.col("g") == g), [], "thread", sums, share, 40).first()
        assert got[g] == (alone.value, alone.low, alone.high)
