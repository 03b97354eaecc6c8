"""Hand-made cases of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.functions import text as T
from letterspark.operators import domains as D
from letterspark.operators import evaluate as L
from letterspark.operators import headers as E
from letterspark.operators import lexicon as P
from letterspark.operators import scoring as K
from letterspark.operators import splits as C
from letterspark.operators import staging as B
from letterspark.plans.components import connected_components
from letterspark.streaming import jobs as M


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_fingerprint_ignores_case_and_signs(spark):
    rows = spark.createDataFrame([("A b-c!",), ("abc",), ("...",), (None,)], "x string").select(B.fingerprint(F.col("x")).alias("f")).collect()
    assert rows[0].f == rows[1].f and rows[2].f is None and rows[3].f is None


def test_components_with_cycles_and_self_links(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5), (9, 8), (8, 7), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 9: 7, 8: 7, 7: 7}


def test_components_of_a_long_chain(spark):
    e = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(e).collect()} == {0}


def test_split_does_not_depend_on_partitions(spark):
    rows = spark.range(400).select("id", F.lit("s").alias("stratum"), (F.col("id") % 90).cast("string").alias("grp"))
    a, b = ({r.id: r.split for r in C.assign_splits(rows.repartition(n), "stratum", "grp").collect()} for n in (1, 7))
    assert a == b and set(a.values()) == {"train", "validation", "test"}


def test_bucket_equals_the_whole_hash(spark):
    import hashlib

    got = one(spark, "key", C.modulo_bucket(F.col("x")).alias("b")).b
    assert got == int(hashlib.sha256(b"key").hexdigest(), 16) % 100


def test_redaction_keeps_punctuation_outside(spark):
    got = one(spark, "see https://a.example.com/x, mail bob@acme.co.uk or shop.example.org.", T.redact(F.col("x")).alias("t")).t
    assert got == "see [URL], mail [EMAIL] or [DOMAIN]."


def test_new_text_cuts_history(spark):
    assert one(spark, "yes\nOn Monday Bob wrote:\n> no", T.new_text(F.col("x")).alias("t")).t == "yes"
    assert one(spark, "> all quoted", T.new_text(F.col("x")).alias("t")).t == "> all quoted"


def test_headers(spark):
    raw = 'From: "Bob <x>" <Bob@Example.com>\nSubject: Re: a\n b\nReceived: by x (10.0.0.1)\nReceived: by y (203.1.2.3)'
    row = one(spark, raw, E.address(E.field(F.col("x"), "From")).alias("a"), E.field(F.col("x"), "Subject").alias("s"), E.origin_ip(F.col("x")).alias("ip"), E.field(F.col("x"), "Date").alias("d"))
    assert tuple(row) == ("bob@example.com", "Re: a b", "203.1.2.3", None)


def test_first_lines_of_trust(spark):
    forged = "Authentication-Results: mx.acme.co.uk; auth=pass\nAuthentication-Results: evilacme.co.uk; dmarc=pass header.from=bank.com"
    bare = "Authentication-Results: spf=pass smtp.mailfrom=a@x.org; dkim=policy\nAuthentication-Results: b.org; dmarc=pass header.from=x.org"
    two = "Authentication-Results: mx.acme.co.uk; dkim=fail header.d=a.org; dkim=pass header.i=@b.org\nAuthentication-Results: hub.acme.co.uk; spf=pass smtp.mailfrom=c.org"
    df = spark.createDataFrame([(1, forged), (2, bare), (3, two), (4, "Received-SPF: Pass (x)"), (5, ""), (6, None)], "id long, raw_headers string")
    got = {r.id: tuple(r)[1:] for r in E.authentication(df).collect()}
    assert got[1] == ("unknown", "unknown", "unknown", "authentication-results", None)
    assert got[2] == ("pass", "policy", "unknown", "authentication-results", "x.org")
    assert got[3] == ("pass", "pass", "unknown", "authentication-results-internal", "b.org")
    assert got[4] == ("pass", "unknown", "unknown", "received-spf", None) and got[5][3] == "none"


def test_similar_domains_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    names = ["".join(rng.choice("abcmrnvw01") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = [(a + ".com", b + ".org") for a, b in zip(names, names[1:])] + [("paypa1.com", "paypal.com"), ("acme.de", "acme.com"), ("localhost", "acme.com"), (None, "acme.com"), ("micros0ft.com", "microsoft.net")]

    def skeleton(x):
        return x.replace("rn", "m").replace("vv", "w").translate(str.maketrans("0135", "oles"))

    def ratio(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return round(200 * t[-1][-1] / (len(a) + len(b)), 1)

    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", D.similarity(F.col("a"), F.col("b")).alias("s"), D.relation(F.col("a"), F.col("b")).alias("r"))
    for a, b, s, r in df.collect():
        if a is None or "." not in a:
            assert s is None and r is None
        else:
            x, y = a.split(".")[0], b.split(".")[0]
            assert abs(s - ratio(skeleton(x), skeleton(y))) < 0.06
            want = "same" if a == b else "suffix" if x == y else "lookalike" if skeleton(x) == skeleton(y) or (s >= 80 and min(len(x), len(y)) >= 6) else None
            assert r == want


def test_removed_pairs_count_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "same text", "a"), (1, "same text", "a"), (2, "same text", "b"), (3, "other", "b")], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in B.removed_pairs(rows, [F.col("doc_id")]).collect()) == [("a", "a", 1), ("b", "a", 1)]


def test_running_sums_keep_rows_without_a_group(spark):
    rows = spark.createDataFrame([("s", "g1"), ("s", "g2"), (None, "g3"), (None, None)], "stratum string, grp string")
    assert C.assign_splits(rows, "stratum", "grp").count() == 4


def test_text_of_all_forms(spark):
    got = one(spark, "HTTP://X.COM/A. hxxp://bad.net http : / / a . com bob @ acme . com setup . exe a.docm paypal . com Mr.Smith", T.redact(F.col("x")).alias("t")).t
    assert got == "[URL]. [URL] [URL] [EMAIL] [FILE] [FILE] [DOMAIN] Mr.Smith"
    row = one(spark, "Hi\n> old\nOn Monday Bob wrote:\n> older\nThanks,\nAnn", T.clean(F.col("x")).alias("c")).c
    assert (row.body_clean, row.quote_removed, row.signature) == ("Hi", True, "")
    assert one(spark, "a\nRegards,\nAnn", T.clean(F.col("x")).alias("c")).c.signature == "Regards, Ann"


def test_longest_phrase_wins_without_overlap(spark):
    lexicon = spark.createDataFrame([("t", "of the", 1.0), ("t", "the", 0.5)], "tactic string, phrase string, weight double")
    docs = spark.createDataFrame([(1, "of the end"), (2, "of the and the"), (3, "none"), (4, "of the end of the"), (5, ""), (6, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in P.tactic_scores(P.phrase_hits(docs, lexicon)).collect()}
    assert got == {1: 1.0, 2: 1.5, 4: 1.0}


def test_score_saturates(spark):
    rows = [(1, "c1", "a", "r", True, "high"), (1, "c2", "a", "r", True, "high"), (2, "c1", "a", "r", None, "not_checkable"), (3, "c1", "a", "r", True, "low")]
    ledger = spark.createDataFrame(rows, "msg_id long, claim_id string, claim_type string, rule string, contradiction boolean, severity string")
    assert {r.msg_id: (r.score, r.band) for r in K.score(ledger).collect()} == {1: (90, "high"), 2: (0, "low"), 3: (5, "low")}
    fired = spark.createDataFrame([(1, "urgency"), (3, "secrecy"), (3, "authority"), (3, "authority"), (3, "gifts")], "msg_id long, tactic string")
    got = {r.msg_id: r.score for r in K.score(ledger, spark.createDataFrame([("r", 0.5)], "rule string, factor double"), fired=fired).collect()}
    assert got == {1: 60, 2: 0, 3: 11}  # (30 + 15) * 1.25 + 4 and 2.5 * 1.25 + 8


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("a", 0.1, 0)], "g string, score double, y int")
    assert L.weighted_auc(rows, "g", "score", F.col("y") == 1).first().auc == 0.875


def test_bootstrap_holds_the_point(spark):
    rows = spark.range(300).select((F.col("id") % 30).alias("c"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    r = L.bootstrap(rows, "c", {"hit": F.sum("y"), "n": F.count("*")}, F.col("hit") / F.col("n"), draws=50).first()
    assert r.low <= r.value <= r.high and abs(r.value - 1 / 3) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A link: http://x.example.com/a."), (2, None), (3, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = M.score_messages(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("scored").collect())) == sorted(map(str, M.score_messages(docs).collect()))
