"""Threads as a stream: equal to the batch ledger, after a restart too; late rows are counted, silent threads expire."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from letterspark.operators import threads as J
from letterspark.plans.fixtures import view
from letterspark.streaming import jobs as M
from letterspark.streaming import threads as S

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def messages(spark):
    S.use_rocksdb(spark)
    return view(spark, DIR, "fx_messages").where("thread_id < 12").withColumn("sent", F.timestamp_seconds(F.col("position") * 60 + 1_700_000_000)).cache()


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return q


def rows(df):
    return sorted((r.msg_key, v.claim_type, v.rule, v.severity) for r in df.collect() for v in r.verdicts)


def test_stream_with_a_restart_equals_the_batch_ledger(spark, messages, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in range(3):  # by time: a thread comes in three pieces
        messages.where(F.least(F.floor(F.col("position") / 2), F.lit(2)) == part).coalesce(1).write.mode("append").parquet(source)
        run(S.score_threads(spark.readStream.schema(messages.schema).parquet(source)), out, state)
    got = spark.read.parquet(out)
    ledger = J.signal_ledger(messages)
    want = sorted((r.msg_key, r.claim_type, r.rule, r.severity) for r in ledger.collect())
    assert rows(got) == want == rows(S.score_threads(messages))
    rank = F.expr("case severity when 'high' then 3 when 'medium' then 2 else 0 end")
    flips = {r.thread_id: r.p for r in ledger.where((rank > 1) & (F.col("position") > 0)).groupBy(F.col("thread_id").cast("string")).agg(F.min("position").alias("p")).collect()}
    found = got.where("flip_key is not null").groupBy("thread_id").agg(F.min("flip_key").alias("k"), F.max("flip_key").alias("m")).collect()
    assert {r.thread_id: int(r.k.split("_")[1]) for r in found} == flips and all(r.k == r.m for r in found) and flips


def test_late_rows_are_counted_and_silent_threads_expire(spark, messages, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    one = messages.where("thread_id = 1 and position < 2")
    later = one.withColumn("sent", F.col("sent") + F.expr("interval 100 days")).withColumn("msg_key", F.concat("msg_key", F.lit("b")))
    other = messages.where("thread_id = 2 and position = 0").withColumn("sent", F.col("sent") + F.expr("interval 60 days"))
    dropped = 0
    for k, piece in enumerate((one, other, other.withColumn("msg_key", F.lit("late")).withColumn("sent", F.col("sent") - F.expr("interval 50 days")), later)):
        piece.coalesce(1).write.mode("append").parquet(source)
        q = run(S.score_threads(spark.readStream.schema(messages.schema).parquet(source), idle=timedelta(days=30)), out, state)
        dropped += sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    n = {r.msg_key: r.n_earlier for r in spark.read.parquet(out).collect()}
    assert dropped == 1 and "late" not in n
    assert n["m1_1"] == 1 and n["m1_0b"] == 0 and n["m1_1b"] == 1  # thread 1 was forgotten


def test_history_is_bounded():
    me = {"sent": 1, "from_addr": "a@x.com", "name_key": None, "local_key": None, "domain": "x.com", "registered": "x.com", "label": "x", "skeleton": "x", "network": None, "family": None, "message_id": "<1>", "shingles": [], "quoted": None, "quoted_words": 0, "ids": [], "in_reply_to": None, "reply": True, "forward": False}
    assert S.judge([], me)[0]["rule"] == "tv_single_no_quote"
    assert [v["rule"] for v in S.judge([me], me)] == ["tv_who_same_address", "tv_path_no_data", "tv_int_no_ids", "tv_quote_none"]
    assert S._status([dict(me, from_addr="a@y.com", domain="y.com", registered="y.com", label="paypal", skeleton="paypal", local_key="aaaaa")], dict(me, label="paypa1", skeleton="paypal", local_key="aaaaa")) == "lookalike"


def test_repeats_are_dropped_within_the_watermark(spark, tmp_path):
    """M3: of equal keys one row stays, in stream as in batch."""
    df = spark.createDataFrame([(k % 3, k) for k in range(9)], "id int, n int").withColumn("ts", F.timestamp_seconds(F.col("n") + 1_700_000_000))
    df.write.parquet(str(tmp_path / "in"))
    stream = M.drop_repeats(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["id"])
    run(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
