"""The surveyed table of phrases against a small matcher by recursion; contacts, sign-offs, organisations and departments by hand."""

from __future__ import annotations

import random
import re

import pytest

from letterspark.operators import claim_phrases as W
from letterspark.operators import claims as H

rng = random.Random(3)
TOKEN = re.compile(r"'(?:m|s|re|ve|ll|d|t)\b|[^\W_]+|[^\w\s]|_")


def fits(part, word):
    low = word.lower()
    return {
        "word": low in part["words"] or any(low.startswith(s) for s in part["stems"]), "not": low not in part["words"], "exact": word in part["words"], "digits": re.fullmatch("[0-9]+", word) is not None, "name": word[:1].isupper(),
    }[part["kind"]]


def longest(tokens, parts, at, i=0):
    """End of the longest match of ``parts[i:]`` at a word, or None."""
    if i == len(parts):
        return at
    p, ends = parts[i], []
    if p["maybe"]:
        ends.append(longest(tokens, parts, at, i + 1))
    if p["kind"] == "gap":
        ends += [longest(tokens, parts, at + k, i + 1) for k in range(p["n"] + 1) if at + k <= len(tokens)]
    else:
        for k in range(1, (p["n"] if p["kind"] == "name" else 1) + 1):
            if at + k > len(tokens) or not fits(p, tokens[at + k - 1]):
                break
            ends.append(longest(tokens, parts, at + k, i + 1))
    return max((e for e in ends if e is not None), default=None)


def sentence():
    """Words drawn from the patterns themselves, so that most of them match somewhere."""
    out = []
    for _ in range(rng.randint(1, 25)):
        for part in W.parse(rng.choice(W.PATTERNS)[2]):
            if part["kind"] == "gap":
                out += rng.choices(["x", "of", "your", ",", "IT"], k=rng.randint(0, part["n"] + 1))
            elif part["kind"] in ("digits", "name"):
                out += {"digits": ["77"], "name": rng.choices(["Acme", "Bank", "of"], k=2)}[part["kind"]]
            elif not part["maybe"] or rng.random() < 0.5:
                out.append(rng.choice((part["words"] if part["kind"] != "not" else ["new"]) + [s + "ing" for s in part["stems"]]))
        if rng.random() < 0.2:
            out += ["[EMAIL]"]
    return rng.choice([" ", "  ", "\n"]).join(w.title() if rng.random() < 0.1 else w for w in out)


@pytest.fixture(scope="module")
def mail(spark):
    texts = [sentence() for _ in range(60)] + ["", None, "the", "\n \n", sentence() * 40]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_all_patterns_equal_brute_force(spark, mail):
    assert len(W.PATTERNS) == 85 and len({p[0] for p in W.PATTERNS}) == 85 and {p[1] for p in W.PATTERNS} == set(H.TYPES)
    want = set()
    for r in mail.collect():
        spans = [m.span() for m in TOKEN.finditer(r.text or "")]
        tokens = [r.text[a:b] for a, b in spans]
        held = lambda k: tokens[k] in ("EMAIL", "URL", "FILE", "DOMAIN") and 0 < k < len(tokens) - 1 and tokens[k - 1] == "[" and tokens[k + 1] == "]"  # noqa: B023, E731
        for name, kind, phrase, confidence in W.PATTERNS:
            parts = W.parse(phrase)
            for at in range(len(tokens)):
                end = longest(tokens, parts, at) if fits(parts[0], tokens[at]) else None
                if end is not None and not held(at) and not held(end - 1):
                    want.add((r.doc_id, kind, spans[at][0], spans[end - 1][1], confidence, name, at, end))
    got = W.match_phrases(mail).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert len({w[5] for w in want}) > 75


def test_bad_phrases_are_refused():
    for phrase in ("", "..2 a", "a ..2", "?a b", "a !b", "ab*", "a ..7 b"):
        with pytest.raises(ValueError):
            W.parse(phrase)


def test_contacts_signoffs_organisations_and_departments(spark):
    """H3, H4, H5, H7, H10 by hand."""
    text = "PayPal security team wrote. Acme sells. Copyright 2024 PayPal.\nTel: +49 30 1234567, fax 2024-01-02, 1234567 mail [EMAIL]\nwe at finance verify all your account details\nBest regards,\nAnn Lee"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    names = spark.createDataFrame([("PayPal",), ("Acme",)], "name string")
    found = {(r.c.pattern, text[r.c.start : r.c.end]) for r in H.organisation_candidates(df, names).where("doc_id = 1").selectExpr("explode(candidates) as c").collect()}
    assert found == {("ae_org_cue", "PayPal security team"), ("ae_org_mention", "Acme"), ("ae_copyright", "Copyright 2024 PayPal")}
    claims = H.extract(df, organisations=names).collect()
    by = {(r.pattern, r.claim): r for r in claims}
    assert ("sc_labelled_contact", "+49 30 1234567") in by and ("sc_labelled_contact", "[EMAIL]") in by and not any("2024-01" in c for _, c in by)
    assert any(p == "sc_signoff_name" and c.endswith("Ann Lee") for p, c in by)
    assert next(r.department for (p, _), r in by.items() if p.startswith("cr_verify")) == "finance"
    far = spark.createDataFrame([(1, "payroll, a b c d e. verify your account x y z , . ; finance"), (2, "payroll a b c d e verify your account")], "doc_id int, text string")
    assert {(r.doc_id, r.department) for r in H.extract(far).collect()} == {(1, None), (2, "payroll")}  # signs are words too
    assert {r.doc_id for r in claims} == {1} and [r.claim_id for r in sorted(claims, key=lambda r: (r.start, r.end))] == [f"c{k + 1}" for k in range(len(claims))]
