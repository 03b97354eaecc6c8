"""The ledger of verdicts is made in one plan, and its checks and scores read it once."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators import bank as N
from letterspark.operators import domains as D
from letterspark.operators import headers as E
from letterspark.operators import rules as R
from letterspark.operators import scoring as K
from letterspark.plans.shared import COMPILED, compiled

LEDGER = "msg_id long, claim_id string, claim_type string, verifier string, rule string, contradiction boolean, severity string, auth_state string, confidence double"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_routing_meets_in_one_grouping(spark):
    """three joins of the ledger with its claims, each of which read both again."""
    claims = [(1, "a", "authority"), (1, "b", "gift_card"), (1, "b", "gift_card"), (2, None, "authority"), (2, "c", "prior_relationship"), (3, "d", "authority"), (None, "e", "authority")]
    rows = [(1, "a", "header"), (1, "a", "header"), (2, None, "header"), (3, "d", "request"), (4, "x", "header"), (4, "x", "header"), (None, "e", "header")]
    found = R.routing_problems(spark.createDataFrame(claims, "msg_id long, claim_id string, type string"), spark.createDataFrame(rows, "msg_id long, claim_id string, verifier string"))
    assert "Join" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [("no row", 5), ("not assigned", 5), ("two rows", 2)]
    empty = R.routing_problems(spark.createDataFrame([], "msg_id long, claim_id string, type string"), spark.createDataFrame([], "msg_id long, claim_id string, verifier string"))
    assert [r.n for r in empty.collect()] == [0, 0, 0]


def test_units_read_the_ledger_once(spark):
    """the ledger was read three times and joined with itself."""
    rows = [
        (1, "a", "authority", "header", "r1", True, "high"), (1, "a", "authority", "header", "r2", True, "low"), (1, "a", "gift_card", "request", "r3", True, "medium"), (1, "b", "authority", "header", "r1", False, "none"),
        (2, "a", "authority", "header", "r1", None, "not_checkable"), (3, "a", "authority", "header", "r1", True, "medium"), (3, "b", "authority", "header", "r1", True, "medium"), (3, None, "authority", "header", "r1", True, "low"),
    ]
    ledger = spark.createDataFrame([(*r, None, None) for r in rows], LEDGER)
    found = K.units(ledger)
    assert "Join" not in plan(found)
    got = {r.msg_id: (r.claims, r.checked, r.contradictions, r.score, r.band) for r in found.collect()}
    assert got == {1: (2, 4, 3, 78, "high"), 2: (1, 0, 0, 0, "low"), 3: (2, 3, 3, 54, "medium")}
    assert {r.msg_id: (r.score, r.band) for r in K.score(ledger).collect()} == {k: v[3:] for k, v in got.items()}
    factors, fired = spark.createDataFrame([("r1", 0.5), ("r3", 0.0)], "rule string, factor double"), spark.createDataFrame([(1, "urgency"), (2, "authority")], "msg_id long, tactic string")
    both = [{r.msg_id: (r.score, r.band) for r in f(ledger, reliability=factors, fired=fired).collect()} for f in (K.units, K.score)]
    assert both[0] == both[1] and both[0][1] != got[1][3:]


def test_discipline_reads_the_ledger_once(spark):
    """each check read the ledger, and two joined it with facts and claims."""
    rows = [
        (1, "a", "x", "header", "hv_auth_ok", False, "none", "unknown", 0.9), (1, "b", "x", "header", "r1", True, "high", "failed", 0.6), (1, "c", "x", "header", "r1", True, "low", None, None), (1, "d", "x", "header", "r2", True, "none", "failed", 0.9),
        (2, "a", "x", "request", "r3", None, "not_checkable", "unknown", 0.9), (2, "b", "x", "request", "r3", None, None, "unknown", 0.9),
    ]
    ledger = spark.createDataFrame(rows, LEDGER)
    found = R.discipline(ledger)
    assert "Join" not in plan(found) and plan(found).count("LogicalRDD") + plan(found).count("LocalRelation") == 1
    assert {r["check"]: (r.value, r.status) for r in found.collect()} == {
        "authentication without a verdict": (1.0, "FAIL"), "weak claims that weigh high": (1.0, "FAIL"), "severity against verdict": (1.0, "FAIL"), "largest share of a rule": (0.666667, "FAIL"),
    }
    assert [(r.value, r.status) for r in R.discipline(ledger.where("false")).collect()] == [(0.0, "PASS")] * 3 + [(None, "PASS")]


def test_authentication_agrees_with_its_parts(spark):
    """Verdicts without cutting headers into all their clauses, on odd headers."""
    a = "Authentication-Results: "
    blocks = [
        "", "From: x", a + "mx.a.de; spf=pass smtp.mailfrom=u@B.org; dkim=fail header.d=c.com; DKIM = Pass header.i=@\"d.com\"", a + "spf=pass smtp.mailfrom=a.com; dmarc=none", a + "mx.a.de", a + ";;spf=fail", a + "mx; header.from=x.de dmarc=bestguesspass; x=y; spf=softfail spf=pass",
        a + "m.a.de; spf=fail\n" + a + "n.a.de; spf=pass smtp.mailfrom=q.com; dkim=pass header.d=e.co.uk\n" + a + "x.evil.com; dmarc=pass header.from=f.com", a + "local; spf=fail\n" + a + "local; dkim=pass header.d=e.com", a + "m.a.de; dkim=passed header.d=z.com; dkim=\tpass\theader.d=",
        a + "m.a.de (a; b) ; (c) spf (x) = pass (y) smtp.mailfrom = h.com", "authentication-results: m.a.de;\n\tdmarc=pass\n header.from=k.com;spf=hardfail", a + "m.a.de; aspf=pass; spf=pass1; dkim=" + "a" * 25, a + "a=b c\n" + a + "a=b; spf=pass smtp.mailfrom=<x@y.com>", a + "; spf=none; spf=pass",
    ]
    rows = spark.createDataFrame(list(enumerate([*blocks, None])), "id int, raw_headers string")
    got = {r.id: r for r in E.authentication(rows).collect()}
    parts: dict = {k: {} for k in got}
    for r in E.trusted(rows).collect():
        parts[r.id][r.method] = r
    reg = lambda d: spark.range(1).select(D.registered(F.lit(d).cast("string"))).first()[0]
    for k, p in parts.items():
        assert [got[k][m] for m in E.METHODS] == [p[m].result if m in p else "unknown" for m in E.METHODS], k
        vouched = [p[m].domain for m in E.METHODS if m in p and p[m].result == "pass" and p[m].domain]
        assert got[k].authenticated_domain == reg(vouched[0] if vouched else None), k
        assert got[k].auth_source == ("none" if not (blocks + [""])[k].lower().startswith("auth") else "authentication-results-internal" if any(x.pos for x in p.values()) else "authentication-results"), k


def test_registered_parts_are_not_searched_again(spark):
    names = ["gmail.com", "t.onmicrosoft.com", "onmicrosoft.com.de", "paypal.com", "paypal.de", "paypa1.com", "senders.co.uk", "sendars.com", "a.x.ck", "www.ck", None]
    one = spark.createDataFrame([(n,) for n in names], "a string")
    pairs = one.crossJoin(one.withColumnRenamed("a", "b"))
    a, b = F.col("a"), F.col("b")
    same = [D.is_free_registered(a).eqNullSafe(D.is_free_mailbox(a)), D.relation_of_registered(a, b).eqNullSafe(D.relation(a, b)), D.relation_to_parts(a, D.parts(F.concat(F.lit("w."), b))).eqNullSafe(D.relation(a, F.concat(F.lit("w."), b)))]
    registered = F.array(a, b).eqNullSafe(F.array(D.registered(a), D.registered(b)))
    rows = pairs.where(registered).select(*(s.alias(f"s{k}") for k, s in enumerate(same)))
    assert rows.count() >= 81 and all(all(r) for r in rows.collect())
    found = D.with_registered(pairs, {"x": a, "y": F.concat(a, F.lit(".."), b)})
    assert not found.where(~(F.col("x").eqNullSafe(D.registered(a)) & F.col("y").eqNullSafe(D.registered(F.concat(a, F.lit(".."), b))))).count()


def test_bank_details_are_only_told(spark):
    texts = [None, "", "plain", "to IBAN DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 01", "account number: 123456", "account 12", "sort code 12-34-56", "(gb82WEST12345698765432)", "ab12 swift", "x" * 5000 + " acct 123456", "no.15 NO93 8601 1117 947"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert not rows.where(N.has_bank_details(F.col("t")) != (F.size(N.bank_details(F.col("t"))) > 0)).count()
    assert rows.where(N.has_bank_details(F.col("t"))).count() == 5


def test_large_methods_are_split(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 65535)
        compiled(spark.range(1))
        assert int(spark.conf.get(key)) == COMPILED
        spark.conf.set(key, 100)
        compiled(spark.range(1))
        assert int(spark.conf.get(key)) == 100
    finally:
        spark.conf.set(key, before)
