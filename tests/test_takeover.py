"""Takeovers of threads by hand and against the verdicts of one message at a time; intervals against a resample."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from letterspark.operators import evaluate as L
from letterspark.operators import takeover as V

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"


@pytest.fixture(scope="module")
def messages(spark):
    rows = []
    for t in range(6):
        for k in range(5):
            text = "too short" if t == 5 else f"{WORDS} of {t} {k}"
            rows.append((f"m{t}_{k}", t, k, "annabel@paypal.com" if k % 2 == 0 else "roberta@paypal.com", "Annabel" if k % 2 == 0 else "Roberta", f"<{t}.{k}@x>", f"<{t}.{k - 1}@x>" if k else None, "", "Re: x" if k else "x", f"9.8.7.{k}", "Apple Mail 2", text, None, "lists" if t else "letters", t > 0))
    return spark.createDataFrame(rows, "msg_key string, thread_id long, position int, from_addr string, from_name string, message_id string, in_reply_to string, refs string, subject string, origin_ip string, mailer string, text string, quoted string, source string, with_ids boolean")


@pytest.fixture(scope="module")
def judged(spark, messages):
    injections = spark.createDataFrame([(t, f"login now {WORDS}", f"thanks {WORDS}", " ".join(f"made{k}" for k in range(40))) for t in range(6)], "thread_id long, attack_body string, benign_body string, fake_quote string")
    cases = V.build_cases(messages, V.make_plan(messages, 3), injections)
    return cases.cache(), V.judge(cases).cache()


def test_points_and_plan(messages):
    assert {(r.thread_id, r.position) for r in V.eligible(messages).collect()} == {(t, k) for t in range(5) for k in (2, 3, 4)}
    plan = V.make_plan(messages, 3).collect()
    assert sorted(r.source for r in plan) == ["letters", "lists", "lists", "lists"] and all(r["index"] in (2, 3, 4) for r in plan)


def test_lookalikes(spark):
    cases = {"mail.paypal.com": "paypa1.com", "zoo.de": "z0o.de", "mumm.org": "rnumm.org", "xyz.com": None, None: None, "localhost": None}
    df = spark.createDataFrame([(d,) for d in cases], "d string")
    assert {r.d: r.x for r in df.select("d", V.lookalike_of(F.col("d")).alias("x")).collect()} == cases


def test_variants_are_told_apart(judged):
    cases, verdicts = judged
    rows = {(r.thread, r.variant): r for r in verdicts.collect()}
    assert {v for t, v in rows if t == "0"} == {"neg_real", "neg_synth", "A", "C"} and {v for t, v in rows if t != "0"} == set(V.LABELS)
    for (thread, variant), r in rows.items():
        want = {"neg_real": [], "neg_synth": [], "A": [], "B": ["path"], "C": ["integrity"]}[variant]
        assert r.groups == want and r.found == bool(want) and r.flip == (r["index"] if want else None), (thread, variant, r)
    b = cases.where("injected and variant = 'B'").first()
    assert b.from_addr.endswith("@paypa1.com") and b.origin_ip.startswith("198.51.100.") and b.mailer == V.MAILERS[0]
    assert {r.status for r in V.isolation_checks(verdicts).collect()} == {"PASS"}
    wrong = verdicts.withColumn("groups", F.when(F.col("variant") == "A", F.array(F.lit("path"))).otherwise(F.col("groups")))
    assert {r.check for r in V.isolation_checks(wrong).where("status = 'FAIL'").collect()} == {"A fires path/integrity"}


def test_rates_need_enough_cases(judged):
    table = V.score_table(judged[1].withColumn("split", F.lit("train")), 50).collect()
    by = {(r.source, r.variant, r.metric): r for r in table}
    detect = by["lists", "attacks", "detect"]
    assert (detect.n, detect.hits) == (9, 6) and detect.rate is None
    assert by["lists", "B", "signal_path"].hits == 3 and by["lists", "A", "flip_early"].hits == 0 and by["letters", "neg_real", "false_alarm_scan"].hits == 0


def test_intervals_equal_a_resample_within_tolerance(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(k % 40), int(rng.random() < 0.3 + (k % 40) / 100), int(rng.random() < 0.5), "ab"[k % 2]) for k in range(4000)]
    df = spark.createDataFrame(rows, "id int, c int, x int, y int, g string")
    sums = {"x": F.sum("x"), "y": F.sum("y"), "n": F.count("*")}
    got = {(r.g, r.statistic): r for r in L.intervals(df, ["g"], "c", sums, {"rate": F.col("x") / F.col("n"), "diff": (F.col("y") - F.col("x")) / F.col("n")}).collect()}
    again = {(r.g, r.statistic): r for r in L.intervals(df.repartition(7), ["g"], "c", sums, {"rate": F.col("x") / F.col("n"), "diff": (F.col("y") - F.col("x")) / F.col("n")}).collect()}
    assert got == again
    for g in "ab":
        table = np.array([[sum(r[2] for r in rows if r[1] == c and r[4] == g), sum(r[3] for r in rows if r[1] == c and r[4] == g), sum(r[1] == c and r[4] == g for r in rows)] for c in range(40)], float)
        table = table[table[:, 2] > 0]
        drawn = table[rng.integers(0, len(table), (4000, len(table)))].sum(1)
        for name, f in (("rate", lambda s: s[..., 0] / s[..., 2]), ("diff", lambda s: (s[..., 1] - s[..., 0]) / s[..., 2])):
            low, high = np.percentile(f(drawn), [2.5, 97.5])
            r = got[g, name]
            assert abs(r.value - f(table.sum(0))) < 1e-9 and abs(r.low - low) < 0.25 * (high - low) and abs(r.high - high) < 0.25 * (high - low)


def test_drops_of_drops(spark):
    rows = [(k, v, int(k % 2), int(k % 2 if v == "raw" else k % 3 == 0), int(k % 2)) for k in range(60) for v in ("raw", "cut")]
    df = spark.createDataFrame(rows, "c int, v string, y int, a int, b int")
    got = {r.statistic: r for r in L.view_contrasts(df, "c", "v", F.col("y") == 1, {"a": F.col("a") == 1, "b": F.col("b") == 1}, "raw", ["cut"], 200).collect()}
    f1 = 2 * 10 / (2 * 10 + 10 + 20)
    assert got["a@raw"].value == got["b@cut"].value == 1 and abs(got["drop a@cut"].value - (1 - f1)) < 1e-9 and abs(got["drop a - drop b@cut"].value - (1 - f1)) < 1e-9
    assert got["drop a - drop b@cut"].low > 0 and got["drop b@cut"].low == got["drop b@cut"].high == 0
