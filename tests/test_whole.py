"""Queries that do the whole job where their registered SQL states a part of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from letterspark.more_queries import ORACLE_SQL, QUERIES
from letterspark.operators import evaluate as L
from tests.test_oracle import DIR, duck, plain  # noqa: F401


def test_contingency_holds_every_document(spark, duck):  # noqa: F811
    rows = QUERIES["d15_contingency"](spark, DIR).toPandas()
    assert plain(rows) == plain(duck.sql(ORACLE_SQL["d15_contingency"]).df())
    docs = duck.sql("select count(*) as n, count(*) filter (where lang is null or lang not in ('en', 'de', 'fr')) as rest from documents").df()
    assert rows[["en", "de", "fr", "other"]].to_numpy().sum() == docs.n[0]
    assert rows["other"].sum() == docs.rest[0] > 0


def test_bootstrap_equals_a_resample(spark):
    rows = spark.range(300).select((F.col("id") * 7 % 31).alias("c"), (F.col("id") % 3 == 0).cast("int").alias("a"), (F.col("id") % 5 < 2).cast("int").alias("b"))
    sums = {"a": F.sum("a"), "b": F.sum("b"), "n": F.count("*")}
    a, b = F.col("a") / F.col("n"), F.col("b") / F.col("n")
    got = {r.statistic: (r.value, r.low, r.high) for r in L.bootstraps(rows, "c", sums, {"a": a, "b": b, "b - a": b - a}).collect()}
    per = rows.groupBy("c").agg(*(v.alias(k) for k, v in sums.items())).orderBy(F.pmod(F.xxhash64("c"), F.lit(1 << 20)), "c").toPandas()
    n = len(per)
    drawn = spark.range(1000 * n).select(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(n)).alias("k")).orderBy("id").toPandas().k.to_numpy().reshape(1000, n)
    table = per[["a", "b", "n"]].to_numpy(float)
    whole, draws = table.sum(0), table[drawn].sum(1)
    for name, f in {"a": lambda x: x[..., 0] / x[..., 2], "b": lambda x: x[..., 1] / x[..., 2], "b - a": lambda x: (x[..., 1] - x[..., 0]) / x[..., 2]}.items():
        assert np.allclose(got[name], [f(whole), *np.percentile(f(draws), [2.5, 97.5])])
    assert tuple(L.bootstrap(rows, "c", sums, a).first()) == got["a"]
