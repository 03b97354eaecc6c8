"""Terms are counted in the row, vectors are made without a second shuffle, and fits have a fixed number of partitions."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from letterspark.operators import classify as M


def test_terms_are_counted_without_a_shuffle(spark):
    """no table of (text, term) is aggregated."""
    rows = spark.createDataFrame([(1, "aa bb aa bb cc"), (2, ""), (3, None), (4, "x"), (5, "dd")], "doc_id long, text string")
    got = M.term_counts(rows, "doc_id", "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert Counter({(r.doc_id, r.term): r.n for r in got.collect()}) == {(1, "aa"): 2, (1, "bb"): 2, (1, "cc"): 1, (1, "aa bb"): 2, (1, "bb aa"): 1, (1, "bb cc"): 1, (5, "dd"): 1}
    terms = spark.createDataFrame([("aa", 0, 1.0), ("bb aa", 1, 2.0)], "term string, place int, idf double")
    vectors = {r.doc_id: (r.k, r.features.toArray().round(6).tolist()) for r in M.text_vectors(rows.withColumn("k", F.col("doc_id") * 2), "doc_id", "text", terms, "k").collect()}
    assert vectors == {1: (2, [0.646129, 0.763228]), **{k: (2 * k, [0.0, 0.0]) for k in (2, 3, 4, 5)}}


def test_partitions_of_a_fit_do_not_grow(spark):
    seen = []
    rows = spark.range(100).selectExpr("id", "id % 2 as y", "cast(id as double) as x").repartition(50)
    rows = M.VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    fit = M.LogisticRegression.fit
    try:
        M.LogisticRegression.fit = lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df)
        M.fit_linear(rows, "y")
    finally:
        M.LogisticRegression.fit = fit
    assert seen[0] <= 2 * spark.sparkContext.defaultParallelism
