"""Hand cases of domains, subjects, mail programs and authentication clauses."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from letterspark.operators import domains as D
from letterspark.operators import headers as E
from letterspark.operators import splits as C
from letterspark.operators import threads as J

DOMAINS = {
    "zenith.xyz": "zenith.xyz", "a.b.bad.top": "bad.top", "paypal.click": "paypal.click", "x.app": "x.app", "mail.paypal.co.uk": "paypal.co.uk", "co.uk": None, "com": None, "localhost": None, "": None, None: None, "..": None,
    "shop.ck": None, "a.shop.ck": "a.shop.ck", "b.a.shop.ck": "a.shop.ck", "www.ck": "www.ck", "x.www.ck": "www.ck", "ck": None, "a.b.kawasaki.jp": "a.b.kawasaki.jp", "b.kawasaki.jp": None, "school.city.kawasaki.jp": "city.kawasaki.jp",
    "city.kawasaki.jp": "city.kawasaki.jp", "acme.onmicrosoft.com": "acme.onmicrosoft.com", "x.acme.onmicrosoft.com": "acme.onmicrosoft.com", "onmicrosoft.com": "onmicrosoft.com", ".GMail.com.": "gmail.com",
}


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_registered_domains_by_expression_and_by_table(spark, tmp_path):
    df = spark.createDataFrame([(d,) for d in DOMAINS], "d string")
    assert {r.d: r.r for r in df.select("d", D.registered(F.col("d")).alias("r")).collect()} == DOMAINS
    path = tmp_path / "rules.dat"
    path.write_text("// the public rules\n\n" + "\n".join(f"{r} " for r in D.SUFFIXES))
    rules = D.suffix_rules(spark, str(path))
    assert {r.rule for r in rules.collect()} == set(D.SUFFIXES)
    found = D.registered_by_rules(df.unionByName(df), "d", rules)
    assert {r.d: r.registered for r in found.collect()} == DOMAINS | {None: None} and found.count() == 2 * len(DOMAINS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(
    ("subject", "bare", "prefixed", "reply", "forward"),
    [
        ("Re: Fwd: Plan", "plan", True, True, False), ("SV: Antw: z", "z", True, False, False), ("RE [2] :  a  b", "a b", True, False, False), ("WG: x", "wg: x", False, False, False), ("fwd: AW: x", "x", True, False, True),
        ("re[123456]: x", "re[123456]: x", False, False, False), ("  Fw:x", "x", True, False, True), ("reply: x", "reply: x", False, False, False), ("re: " * 25 + "x", "re: " * 5 + "x", True, True, False),
    ],
)
def test_subjects(spark, subject, bare, prefixed, reply, forward):
    s = F.col("s")
    row = spark.createDataFrame([(subject,)], "s string").select(J.normalise_subject(s), J.has_prefix(s), J.is_reply(s), J.is_forward(s)).first()
    assert tuple(row) == (bare, prefixed, reply, forward)


def test_thread_keys_have_no_prefixes(spark):
    assert [one(spark, C.thread_key, x) for x in ("Antw: z", "sv:RE: z!", "WG: z", "vs: z")] == ["z", "z", "wgz", "vsz"]


def test_mail_programs_and_networks(spark):
    families = {"Apple Mail (2.3774.600.62)": "apple mail", "Outlook 15": "outlook", "Outlook 16": "outlook", "Mozilla Thunderbird": "mozilla thunderbird", "Mozilla Firefox": "mozilla firefox", "7.1": None, None: None, "The Bat! v3 Home Edition Pro": "the bat home"}
    assert {x: one(spark, J.mailer_family, x) for x in families} == families
    networks = {"1.2.3.4": "1.2.3", "2001:db8:1:2:3::4": "2001:db8:1:2", "::1": "::1", "odd": "odd", "": None, None: None}
    assert {x: one(spark, J.network_of, x) for x in networks} == networks


def test_path_drift_ignores_versions(spark):
    rows = [("m0", "t", 0, "a@x.com", "1.2.3.4", "Outlook 15"), ("m1", "t", 1, "a@x.com", "1.2.3.9", "Outlook 16"), ("m2", "t", 2, "a@x.com", "1.2.4.9", "Mozilla Firefox"), ("m3", "t", 3, "b@x.com", "9.9.9.9", "Pine"), ("m4", "t", 4, "a@x.com", None, None)]
    df = spark.createDataFrame(rows, "msg_key string, thread_id string, position int, from_addr string, origin_ip string, mailer string")
    assert {r.msg_key: (r.new_network, r.new_mailer) for r in J.path_drift(df).collect()} == {"m0": (None, None), "m1": (False, False), "m2": (True, True), "m3": (None, None), "m4": (None, None)}


def test_authentication_parses_each_clause_once(spark):
    line = "Authentication-Results: mx.acme.co.uk; dkim=fail header.d=list.org; dkim=pass header.i=@mail.sender.com; spf = hardfail smtp.mailfrom=a@b.org; arc=none; dmarc=none (p=x; q)"
    df = spark.createDataFrame([(1, line)], "id int, raw_headers string")
    assert {(r.method, r.result, r.domain) for r in E.verdicts(df).collect()} == {("dkim", "pass", "mail.sender.com"), ("spf", "fail", "b.org"), ("dmarc", "none", None)}
    plan = E.authentication(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_") < 30
