"""Header blocks are read once, and suffixes are found by their last labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators import domains as D
from letterspark.operators import headers as E


def test_header_values_are_read_once_from_one_block(spark):
    """no plan holds a copy of the block for each header, nor a literal for each suffix."""
    rows = spark.createDataFrame([(1, "s", "From: <a@x.co.uk>")], "id long, source string, raw_headers string").withColumn("raw_headers", F.concat("raw_headers", F.lit("\nTo: b@y.de")))
    for found in (E.evidence(rows), E.problem_tally(E.fields(rows))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[ \\t]+,") == 1 and plan.count("ltd.uk") <= 12


def test_suffixes_by_last_labels(spark):
    """The longest rule, wildcards and exceptions as before, also with empty labels and no name."""
    cases = {"a..b.co.uk.": "b.co.uk", "co.uk": None, "x.ck": None, "a.x.ck": "a.x.ck", "a.www.ck": "www.ck", "city.kawasaki.jp": "city.kawasaki.jp", "a.b.kawasaki.jp": "a.b.kawasaki.jp", "b.kawasaki.jp": None,
             "t.onmicrosoft.com": "t.onmicrosoft.com", "onmicrosoft.com": "onmicrosoft.com", " A.De ": "a.de", "": None, "localhost": None, "com,org": None}
    rows = spark.createDataFrame(list(cases.items()), "d string, r string").select("d", "r", D.registered(F.col("d")).alias("x")).collect()
    assert all(r.r == r.x for r in rows), [tuple(r) for r in rows if r.r != r.x]
