"""Common subsequences by the bits of whole numbers, and tables whose row groups leave splits empty."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from letterspark.operators import domains as D
from letterspark.plans.shared import spread


def brute(a: str, b: str) -> int:
    before = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        before = row
    return before[-1]


def test_common_lengths_of_any_size_equal_brute_force(spark):
    """lengths on both sides of a whole number's bits, letters of more than one byte or UTF-16 unit, and none."""
    rng = random.Random(5)
    sizes = [0, 1, 2, 7, 30, 62, 63, 64, 65, 130]
    rows = [(*("".join(rng.choice(letters) for _ in range(n)) for n in (m, k)),) for letters in ("ab", "abcdefgh.-", "aаé😀𝒳\\[") for m in sizes for k in sizes]
    rows += [("a" * 63, "a" * 63), ("a" * 63, "a" * 400), ("ab" * 200, "ba" * 20), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    for a, b, n in df.select("a", "b", D.common_length(F.col("a"), F.col("b"))).collect():
        assert n == (brute(a, b) if a and b else 0), (a, b)


def test_letters_cost_no_table(spark):
    """one row of 63 by 5,000 letters took 28 s, as each cell of a table copied its row."""
    pair = lambda n: spark.range(1).select(F.repeat(F.lit("abc"), 21).alias("a"), F.repeat(F.lit("cab-"), n).alias("b")).select(D.common_length(F.col("a"), F.col("b")).alias("n"))
    assert pair(30).first().n == 63
    began = time.monotonic()
    assert pair(1250).first().n == 63 and time.monotonic() - began < 10


def test_both_columns_agree_with_their_functions(spark):
    domains = ["paypal.com", "paypa1.com", "mail.paypal.co.uk", "localhost", None, "", "rnicrosoft.net", "microsofft.com", "microsoft.com", "co.uk", ".GMail.com.", "acme.onmicrosoft.com", "pаypal.org", "abcdefgh.com", "badcfehg.de", "x" * 70 + ".com", "x" * 69 + "y.de", "vvalmart.com", "walmart.com"]
    one = spark.createDataFrame([(d,) for d in domains], "a string")
    pairs = one.crossJoin(one.select(F.col("a").alias("b")))
    a, b = F.col("a"), F.col("b")
    got = pairs.select(D.compare(a, b).alias("c"), D.similarity(a, b).alias("s"), D.relation(a, b).alias("r"))
    assert not got.where("not (c.similarity <=> s and c.relation <=> r)").count() and got.where("r = 'lookalike'").count()


def test_row_groups_that_leave_splits_empty_use_all_cores(spark, tmp_path):
    """a file of more splits than cores and one row group ran in one task."""
    rng = random.Random(1)
    pq.write_table(pa.table({"x": [rng.getrandbits(62) for _ in range(200_000)]}), tmp_path / "t.parquet")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = spread(spark.read.parquet(str(tmp_path / "t.parquet")))
        held = df.groupBy(F.spark_partition_id()).count().collect()
        assert len(held) == spark.sparkContext.defaultParallelism and sum(r["count"] for r in held) == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
