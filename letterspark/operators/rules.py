"""Evidence rules: claims joined with the facts of their message give a ledger of three-valued verdicts.

A rule never guesses: what the headers can't show is ``not_checkable`` (NULL), never passed.
Each verifier is one projection of ordered conditions; no rule needs a shuffle beyond the
join of claims and facts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterspark.functions.text import bind
from letterspark.operators.domains import is_free_registered, registered, relation, relation_of_registered
from letterspark.operators.scoring import shift

# Which verifier checks which type of claim.
ROUTES = {
    "affiliation_internal": "header", "affiliation_external": "header", "authority": "header", "reply_direction": "header", "signature_contact": "header", "prior_relationship": "thread",
    "payment_request": "request", "payment_change": "request", "credential_request": "request", "gift_card": "request", "data_request": "request",
}
REQUESTS = tuple(k for k, v in ROUTES.items() if v == "request")
# Words that begin a footer or a quoted header, and rules of signatures that hold no contact.
FOOTERS = (
    "unsubscribe", "subscription", "list maintainer", "mailing list", "mailman", "majordomo", "listserv", "yahoogroups", "egroups", "googlegroups", "additional commands", "managing the list", "on behalf of", "sent:",
    "x-spam", "envfrom", "original message", "wrote:",
)
NO_CONTACT = ("sc_street", "sc_street_zip", "sc_in_error", "sc_notify_sender", "sc_copyright", "sc_sent_by", "sc_receiving", "sc_signoff_name")
# Requests whose messages are searched for bank details, and steps on the ladder of severities by the type of a request.
PAYMENTS = ("payment_change", "payment_request")
ADJUST = {"payment_change": 1, "gift_card": 1, "data_request": -1}

col = F.col


def auth_state(spf: Column, dkim: Column, dmarc: Column, aligned: Column, lists: Column, vouched: Column) -> Column:
    """What authentication shows about the sender, in one word of seven."""
    known = reduce(lambda a, b: a | b, (F.coalesce(x != "unknown", F.lit(False)) for x in (spf, dkim, dmarc)))
    return (
        F.when(~known, "unknown").when(dmarc == "fail", "failed").when(aligned, "aligned").when(lists, "list_relayed")
        .when(vouched.isNotNull() & ~aligned, "other_domain").when(spf.isin("fail", "softfail"), "spf_failed").otherwise("no_pass")
    )


def addresses(text: Column, most: int = 8) -> Column:
    """Registered domains of the addresses in the first 1,000 characters of a contact block: in order, distinct, at most ``most``."""
    found = F.regexp_extract_all(F.substring(F.coalesce(text, F.lit("")), 1, 1000), F.lit(r"[\p{L}\p{N}._%+-]@([\p{L}\p{N}.-]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.array_compact(F.transform(found, lambda x: registered(F.trim(x, F.lit(".-")))))), 1, most)


def sender_block(text: Column) -> Column:
    """A signature up to the first word of a footer or quoted header."""
    at = F.least(*(F.nullif(F.locate(w, F.lower(text)), F.lit(0)) for w in FOOTERS))
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1))


def clean_text(value: Column, most: int = 80) -> Column:
    """Letters, digits and a few signs of text from a message, squeezed and cut, fit to be shown."""
    kept = F.regexp_replace(F.substring(F.coalesce(value, F.lit("")), 1, 3 * most), r"[^\p{L}\p{N} .,_'&()-]", " ")
    return F.substring(F.trim(F.regexp_replace(kept, " +", " ")), 1, most)


def clean_domain(value: Column, most: int = 80) -> Column:
    kept = F.trim(F.regexp_replace(F.lower(F.substring(value, 1, 200)), r"[^\p{L}\p{N}.-]", ""), F.lit(".-"))
    return F.nullif(F.substring(kept, 1, most), F.lit(""))


def related(rows: DataFrame, domain: str, target: str, out: str) -> DataFrame:
    """Adds what a domain is to a target, judged once for each pair of different domains."""
    pairs = rows.select(domain, target).where(col(domain).isNotNull() & col(target).isNotNull()).distinct()
    return rows.join(pairs.withColumn(out, relation(col(domain), col(target))), [domain, target], "left")


def prepare_facts(evidence: DataFrame) -> DataFrame:
    """Facts that the rules read, from the columns of ``headers.evidence`` and ``name_address``, in their own row."""
    own, org = col("from_registered"), F.when(~col("list_mail"), col("org_domain"))
    rows = evidence.withColumn("org_domain", org).withColumns({"from_matches_org": own == col("org_domain"), "external": own != col("org_domain")})
    state = auth_state(col("spf"), col("dkim"), col("dmarc"), col("auth_aligned"), col("list_mail"), col("authenticated_domain"))
    return rows.withColumns({"auth_state": state, "name_domain": col("name_has_address") & ~col("name_address"), "org_relation": relation_of_registered(own, col("org_domain"))})


def best_relation(rows: DataFrame, targets: DataFrame, key: list[str], domain: str) -> DataFrame:
    """``(key, relation, near)``: the strongest relation of a domain to the targets (``key``, ``target``): same, lookalike, suffix; NULL if none."""
    joined = related(rows.select(*key, domain).distinct().join(targets, key), domain, "target", "_r")
    rank = F.when(col("_r") == "same", 3).when(col("_r") == "lookalike", 2).when(col("_r") == "suffix", 1)
    return joined.withColumn("_k", rank).groupBy(*key).agg(F.max_by("_r", F.struct("_k", "target")).alias("relation"), F.max_by(F.when(col("_k").isNotNull(), col("target")), F.struct("_k", "target")).alias("near"))


def strongest_relation(domain: Column, targets: Column, judge: Callable[[Column, Column], Column] = relation) -> Column:
    """The relation of ``best_relation`` for targets that stand in an array of their own row: no join, no shuffle. ``judge``: ``relation``, or one for what the sides are known to be."""
    found = lambda known: F.coalesce(*(F.when(F.array_contains(known, r), r) for r in ("same", "lookalike", "suffix")))
    return bind(F.transform(targets, lambda d: judge(domain, d)), found)


def verdict(*outcomes: tuple[Column | None, str, str]) -> Column:
    """``(rule, severity)`` of the first condition that holds; the last outcome has none."""
    out = None
    for condition, rule, severity in outcomes:
        s = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
        out = (F.when(condition, s) if out is None else out.when(condition, s)) if condition is not None else out.otherwise(s)
    return out


NONE, OPEN = "none", "not_checkable"


def vouched(prefix: dict[str, str], condition: Column) -> list[tuple[Column, str, str]]:
    """Outcomes for a sender on the claimed organisation's own domain: authentication decides; ``prefix``: rule ids by state."""
    state = col("auth_state")
    levels = {"failed": "high", "other_domain": "medium", "spf_failed": "medium", "no_pass": "low", "aligned": NONE}
    return [*((condition & (state == s), prefix[s], level) for s, level in levels.items()), (condition, prefix["unknown"], OPEN)]


def internal() -> Column:
    """Does the sender belong to the recipient's organisation?"""
    rules = {"failed": "hv_int_spoof", "other_domain": "hv_int_auth_other", "spf_failed": "hv_int_spf_fail", "no_pass": "hv_int_no_pass", "aligned": "hv_int_ok_auth", "unknown": "hv_int_no_auth"}
    return verdict(
        (col("list_mail"), "hv_int_list", OPEN), (col("org_domain").isNull(), "hv_int_no_org", OPEN), (col("from_registered").isNull(), "hv_int_no_from", OPEN), *vouched(rules, col("from_matches_org")),
        (col("freemail"), "hv_int_freemail", "high"), (col("org_relation") == "lookalike", "hv_int_lookalike", "high"), (col("org_relation") == "suffix", "hv_int_suffix", "medium"), (None, "hv_int_other_domain", "low"),
    )


def external() -> Column:
    """Does the sender belong to the outside organisation named? Reads ``brand``, ``named``, ``speaks``, ``brand_domains``, ``brand_relation``."""
    rules = {"failed": "hv_ext_brand_spoof", "other_domain": "hv_ext_brand_auth_other", "spf_failed": "hv_ext_brand_spf_fail", "no_pass": "hv_ext_brand_no_pass", "aligned": "hv_ext_brand_ok", "unknown": "hv_ext_brand_no_auth"}
    unknown = col("brand").isNull()
    return verdict(
        (col("from_registered").isNull(), "hv_ext_no_from", OPEN), (unknown & (F.coalesce("named", F.lit("")) == ""), "hv_ext_no_org", OPEN), (~F.coalesce("speaks", F.lit(False)), "hv_ext_reference", OPEN),
        (unknown & col("freemail"), "hv_ext_unknown_freemail", "low"), (unknown, "hv_ext_unknown_org", OPEN), *vouched(rules, F.array_contains("brand_domains", col("from_registered"))),
        (F.array_contains("brand_domains", col("authenticated_domain")), "hv_ext_signed_by_brand", NONE), (col("freemail"), "hv_ext_freemail", "high"), (col("brand_relation") == "lookalike", "hv_ext_lookalike", "high"),
        (col("name_address"), "hv_ext_name_spoof", "high"), (col("brand_relation") == "suffix", "hv_ext_suffix", "medium"), (None, "hv_ext_other_domain", "medium"),
    )


def _against_rank() -> list[Column]:
    """Rules of the signals against a claimed rank, the strongest first; NULL for those that aren't there."""
    state, lookalike = col("auth_state"), (col("org_relation") == "lookalike") & ~F.coalesce("from_matches_org", F.lit(False))
    found = [
        (col("name_address"), "hv_auth_name_address"), (lookalike, "hv_auth_lookalike"), (state == "failed", "hv_auth_dmarc_fail"),
        (col("freemail"), "hv_auth_freemail"), (state == "spf_failed", "hv_auth_spf_fail"), (state == "no_pass", "hv_auth_no_pass"),
    ]
    return [F.when(c, r) for c, r in found]


def authority_signals() -> Column:
    """Rules of all signals against a claimed rank, the strongest first."""
    return F.array_compact(F.array(*_against_rank()))


AUTHORITY = {"hv_auth_name_address": "high", "hv_auth_lookalike": "high", "hv_auth_dmarc_fail": "high", "hv_auth_freemail": "medium", "hv_auth_spf_fail": "medium", "hv_auth_no_pass": "low"}


def authority() -> Column:
    first = F.coalesce(*_against_rank())
    return verdict(
        (col("from_registered").isNull(), "hv_auth_no_from", OPEN), *((first == r, r, s) for r, s in AUTHORITY.items()), (col("auth_state") == "aligned", "hv_auth_ok", NONE), (None, "hv_auth_no_evidence", OPEN),
    )


def reply() -> Column:
    """Are replies sent elsewhere?"""
    away, to = col("reply_to_divergence"), col("reply_domain")
    free = is_free_registered(to) & ~F.coalesce("freemail", F.lit(False))
    return verdict(
        (away & free, "hv_reply_diverges", "high"), (away & (relation_of_registered(to, col("from_registered")) == "lookalike"), "hv_reply_diverges", "high"), (away, "hv_reply_diverges", "medium"),
        (~away & to.isNotNull(), "hv_reply_ok", NONE), (None, "hv_reply_no_header", OPEN),
    )


def signature() -> Column:
    """Do the addresses of the signature belong to the sender? Reads ``signature_domains``, ``signature_relation``, ``pattern``."""
    own, shown = col("from_registered"), col("signature_domains")
    mine, company = F.array_contains(shown, own), F.exists(shown, lambda d: ~is_free_registered(d))
    return verdict(
        (F.coalesce(col("pattern").isin(*NO_CONTACT), F.lit(False)), "hv_sig_not_contact", OPEN), (own.isNull(), "hv_sig_no_from", OPEN), (F.size(shown) == 0, "hv_sig_no_address", OPEN),
        (mine & col("freemail"), "hv_sig_same_freemail", OPEN), (mine, "hv_sig_ok", NONE), (col("signature_relation") == "lookalike", "hv_sig_lookalike", "high"),
        (col("freemail") & company & col("list_mail"), "hv_sig_freemail_sender", "low"), (col("freemail") & company, "hv_sig_freemail_sender", "medium"), (None, "hv_sig_other_domain", "low"),
    )


def _about_asker() -> list[Column]:
    """``(severity rank, order, rule)`` of each signal about who asks, the least the strongest; NULL for those that aren't there."""
    state = col("auth_state")
    found = [
        (F.coalesce(col("org_relation") == "lookalike", F.lit(False)) | F.coalesce(col("brand_relation") == "lookalike", F.lit(False)), "rv_lookalike", F.lit(3)), (state == "failed", "rv_auth_fail", F.lit(3)),
        (col("freemail"), "rv_freemail", F.when(col("external"), 3).otherwise(2)), (col("reply_to_divergence"), "rv_reply_redirect", F.lit(2)), (col("name_address"), "rv_name_address", F.lit(2)),
        (col("name_domain"), "rv_name_domain", F.lit(1)), (state == "spf_failed", "rv_spf_fail", F.lit(2)), (state == "no_pass", "rv_no_pass", F.lit(1)),
    ]
    return [F.when(c, F.struct((-rank).alias("rank"), F.lit(k).alias("no"), F.lit(r).alias("rule"))) for k, (c, r, rank) in enumerate(found)]


def asker_signals() -> Column:
    """The signals about who asks, the strongest first."""
    return F.array_sort(F.array_compact(F.array(*_about_asker())))


def request() -> Column:
    """Who asks? Reads ``has_bank_details`` of the message besides the facts."""
    first = F.least(*_about_asker())
    carries = F.coalesce("has_bank_details", F.lit(False))
    steps = F.coalesce(*(F.when(col("type") == k, v) for k, v in ADJUST.items()), F.lit(0)) + (col("type").isin(*PAYMENTS) & carries).cast("int")
    severity = shift(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (-first["rank"]).cast("int")), steps)
    rest = verdict((col("type") == "payment_change", "rv_change_needs_thread", OPEN), (col("auth_state") == "aligned", "rv_ok", NONE), (None, "rv_no_proof", OPEN))
    return F.when(col("from_registered").isNull(), F.struct(F.lit("rv_no_from").alias("rule"), F.lit(OPEN).alias("severity"))).when(first.isNotNull(), F.struct(first["rule"].alias("rule"), severity.alias("severity"))).otherwise(rest)


RULES = {"affiliation_internal": internal, "affiliation_external": external, "authority": authority, "reply_direction": reply, "signature_contact": signature}


#: What a signal says in a reason; ``{own}`` and ``{reply}`` stand for the sender's domain and that of replies.
SIGNAL_TEXTS = {
    "hv_auth_name_address": "the name shows another address", "hv_auth_lookalike": "{own} resembles the organisation's domain", "hv_auth_dmarc_fail": "DMARC failed",
    "hv_auth_freemail": "{own} gives mailboxes to anyone", "hv_auth_spf_fail": "SPF failed", "hv_auth_no_pass": "no check passed",
    "rv_lookalike": "{own} resembles another's domain", "rv_auth_fail": "DMARC failed", "rv_freemail": "{own} gives mailboxes to anyone", "rv_reply_redirect": "replies go to {reply}",
    "rv_name_address": "the name shows another address", "rv_name_domain": "the name shows another domain", "rv_spf_fail": "SPF failed", "rv_no_pass": "no check passed",
}
#: What a row without signals says, by the last part of its rule or by the rule.
RULE_TEXTS = {
    "no_from": "The message has no usable sender.", "hv_auth_ok": "The sender is authenticated; the rank itself can't be checked.", "hv_auth_no_evidence": "Nothing shows who the sender is.",
    "rv_ok": "The sender is authenticated; that says nothing about the request.", "rv_no_proof": "Nothing shows who asks.", "rv_change_needs_thread": "Headers can't confirm new payment details.",
}
#: Most signals in a reason, most details in the evidence, most characters of a reason.
MOST_SIGNALS, MOST_SHOWN, MOST_REASON = 3, 4, 400


def signals() -> Column:
    """Rules of all signals behind a row of the authority and request rules, the strongest first; none for others."""
    asked = F.transform(asker_signals(), lambda s: s["rule"])
    return F.coalesce(F.when(col("type") == "authority", authority_signals()).when(col("type").isin(*REQUESTS), asked), F.array().cast("array<string>"))


def reason(found: Column, rule: Column, shown: Column) -> Column:
    """One sentence on a row of the authority and request rules from its signals, its rule and its masked details."""

    def said(signal: Column) -> Column:
        text = F.coalesce(*(F.when(signal == k, v) for k, v in SIGNAL_TEXTS.items()), signal)
        return F.replace(F.replace(text, F.lit("{own}"), F.coalesce(clean_domain(col("from_registered")), F.lit("?"))), F.lit("{reply}"), F.coalesce(clean_domain(col("reply_domain")), F.lit("?")))

    start = F.when(col("type") == "authority", "Claims a rank, but ").otherwise("Asks for something, but ")
    details = F.when(F.size(shown) > 0, F.concat(F.lit(" Bank details: "), F.array_join(shown, ", "), F.lit("."))).otherwise("")
    told = F.concat(start, F.array_join(F.transform(F.slice(found, 1, MOST_SIGNALS), said), "; "), F.lit("."), details)
    plain = F.coalesce(*(F.when(rule.endswith(k), v) for k, v in RULE_TEXTS.items()), rule)
    return F.substring(F.when((F.size(found) > 0) & ~rule.endswith("no_from"), told).otherwise(plain), 1, MOST_REASON)


#: Claims whose rows ``evidence`` explains.
EVIDENT = ("authority", *REQUESTS)


def _judged(claims: DataFrame, facts: DataFrame | None, key: str, types: tuple[str, ...] = (*RULES, *REQUESTS)) -> DataFrame:
    """Claims of some types that headers can judge, with their facts and ``verifier, rule, contradiction, severity``; what only rules of other types read isn't made."""
    rows = claims.where(col("type").isin(*types))
    if facts is not None:
        rows = rows.join(facts, key, "left")
    if "has_bank_details" not in rows.columns:
        rows = rows.withColumn("has_bank_details", F.size("bank_details") > 0 if "bank_details" in rows.columns else F.lit(False))
    if "bank_details" not in rows.columns:
        rows = rows.withColumn("bank_details", F.array().cast("array<struct<kind:string,value:string,masked:string>>"))
    v = F.coalesce(*(F.when(col("type") == k, f()) for k, f in RULES.items() if k in types), F.when(col("type").isin(*REQUESTS), request()))
    route = F.coalesce(*(F.when(col("type") == k, r) for k, r in ROUTES.items()))
    rows = rows.withColumn("verifier", route).where("verifier in ('header', 'request')").withColumn("_v", v)
    contradiction = F.when(~col("_v.severity").isin(NONE, OPEN), True).when(col("_v.severity") == NONE, False)
    severity = F.when(contradiction & (F.coalesce("confidence", F.lit(1.0)) < 0.9), shift(col("_v.severity"), F.lit(-1))).otherwise(col("_v.severity"))
    return rows.withColumns({"rule": col("_v.rule"), "contradiction": contradiction, "severity": severity}).drop("_v")


def verify(claims: DataFrame, facts: DataFrame | None, key: str = "msg_id", *keep: str) -> DataFrame:
    """The ledger: one row for each claim that headers can judge, with ``claim_id, claim_type, verifier, rule, contradiction, severity``.

    ``claims``: key, claim_id, type, confidence and what the rules read; ``facts``: those of ``prepare_facts`` and, if payments
    are to be judged by them, ``bank_details`` or only ``has_bank_details``; None if claims stand beside their facts already.
    ``keep``: columns of either that the ledger keeps. A contradicted weak claim counts one step less.
    Claims of the thread verifier are left out; claims without facts have no usable sender.
    """
    return _judged(claims, facts, key).select(key, "claim_id", col("type").alias("claim_type"), "verifier", "rule", "contradiction", "severity", *keep)


def evidence(claims: DataFrame, facts: DataFrame | None, key: str = "msg_id") -> DataFrame:
    """Rows of ``verify`` by the authority and request rules with what they rest on.

    ``signals``: all of them, the strongest first, though only the first sets rule and severity; ``shown``: masked bank
    details of payment claims; ``strength``: weak or strong; ``reason``: one sentence.
    """
    rows = _judged(claims, facts, key, EVIDENT)
    details = F.when(col("type").isin(*PAYMENTS), F.transform(F.slice("bank_details", 1, MOST_SHOWN), lambda d: d["masked"]))
    rows = rows.withColumns({"signals": signals(), "shown": F.coalesce(details, F.array().cast("array<string>"))})
    weak = F.when(F.coalesce("confidence", F.lit(1.0)) < 0.9, "weak").otherwise("strong")
    return rows.select(
        key, "claim_id", col("type").alias("claim_type"), "verifier", "rule", "contradiction", "severity", "auth_state", "signals", "shown",
        weak.alias("strength"), reason(col("signals"), col("rule"), col("shown")).alias("reason"),
    )


def row_problems(verifiers: dict[str, str], signal_id: str = "thread", most_reason: int = MOST_REASON) -> Column:
    """What a ledger row breaks of its contract: names of problems, none for a sound row.

    ``verifiers``: the verifier that each known rule belongs to. Reads ``verifier, rule, contradiction, severity, claim_id,
    claim_type, reason``; rows of thread signals bear ``signal_id``.
    """
    owners = F.create_map(*(F.lit(x) for pair in verifiers.items() for x in pair))
    owner = F.try_element_at(owners, F.coalesce("rule", F.lit("")))
    fits = F.when(col("contradiction"), col("severity").isin("low", "medium", "high")).when(~col("contradiction"), col("severity") == NONE).otherwise(col("severity") == OPEN)
    long = F.coalesce(F.length("reason").between(10, most_reason), F.lit(False))
    checks = {
        "unknown verifier": ~F.coalesce(col("verifier").isin("header", "request", "thread"), F.lit(False)), "unknown rule": owner.isNull(),
        "rule of another verifier": owner != F.coalesce("verifier", F.lit("")), "severity against verdict": ~F.coalesce(fits, F.lit(False)), "length of the reason": ~long,
        "markup in the reason": F.coalesce(col("reason").rlike(r"[<>`\p{Cntrl}]"), F.lit(False)), "signal under a claim": (col("claim_type") == "signal") & (F.coalesce("claim_id", F.lit("")) != signal_id),
    }
    return F.array_compact(F.array(*(F.when(c, name) for name, c in checks.items())))


def check_ledger(ledger: DataFrame, claims: DataFrame, verifiers: dict[str, str], key: str = "msg_id", signal_id: str = "thread") -> DataFrame:
    """``(problem, n)``: rows that break the contract, rows on claims that weren't found, claims with several rows of a verifier; problems that occur."""
    broken = ledger.select(F.explode(row_problems(verifiers, signal_id)).alias("problem"))
    own = ledger.where(~F.coalesce(col("claim_id") == signal_id, F.lit(False)))
    lost = own.join(claims.select(key, "claim_id").distinct(), [key, "claim_id"], "left_anti").select(F.lit("no such claim").alias("problem"))
    twice = own.groupBy(key, "claim_id", "verifier").count().where("count > 1").select(F.lit("several rows of a verifier").alias("problem"))
    return broken.unionByName(lost).unionByName(twice).groupBy("problem").agg(F.count("*").alias("n"))


def _side_by_side(df: DataFrame, *rows: tuple[Column, ...], names: tuple[str, ...]) -> DataFrame:
    """A row of ``df`` as several rows with columns ``names``."""
    return df.select(F.inline(F.array(*(F.struct(*(v.alias(n) for v, n in zip(row, names, strict=True))) for row in rows))))


def routing_problems(claims: DataFrame, ledger: DataFrame, key: str = "msg_id") -> DataFrame:
    """``(problem, n)``: claims without a row, rows without a claim, claims with two rows of a verifier. Both sides meet in one grouping; a key that is NULL meets none."""
    route = F.coalesce(*(F.when(col("type") == k, r) for k, r in ROUTES.items()))
    on = [key, "claim_id", "verifier"]
    due = claims.select(key, "claim_id", route.alias("verifier"), F.lit(1).alias("_due"), F.lit(0).alias("_made")).where("verifier in ('header', 'request')")
    met = due.unionByName(ledger.select(*on, F.lit(0).alias("_due"), F.lit(1).alias("_made"))).groupBy(*on).agg(F.sum("_due").alias("due"), F.sum("_made").alias("made"))
    alone = reduce(lambda a, b: a | b, (col(c).isNull() for c in on))
    total = lambda value: F.coalesce(F.sum(value), F.lit(0).cast("long"))
    n = met.agg(total(F.when(alone | (col("made") == 0), col("due"))).alias("lost"), total(F.when(alone | (col("due") == 0), col("made"))).alias("extra"), F.count_if(col("made") > 1).alias("twice"))
    return _side_by_side(n, (F.lit("no row"), col("lost")), (F.lit("not assigned"), col("extra")), (F.lit("two rows"), col("twice")), names=("problem", "n"))


#: Rules that reach their verdict through authentication.
READS_AUTH = ("hv_int_spoof", "hv_int_auth_other", "hv_int_spf_fail", "hv_int_no_pass", "hv_int_ok_auth", "hv_ext_brand_spoof", "hv_ext_brand_auth_other", "hv_ext_brand_spf_fail", "hv_ext_brand_no_pass",
              "hv_ext_brand_ok", "hv_ext_signed_by_brand", "hv_auth_dmarc_fail", "hv_auth_spf_fail", "hv_auth_no_pass", "hv_auth_ok", "rv_ok", "rv_auth_fail", "rv_spf_fail", "rv_no_pass")


def discipline(ledger: DataFrame, dominant: float = 0.6) -> DataFrame:
    """``(check, value, status)``: no verdict through authentication without one, no weak claim that weighs high, severities fit, no rule with most contradictions.

    ``ledger``: with the ``auth_state`` and ``confidence`` that its rows rest on (``verify`` keeps them). One pass counts by rule; the checks read the counts.
    """
    fits = F.when(col("contradiction"), col("severity").isin("low", "medium", "high")).when(~col("contradiction"), col("severity") == NONE).otherwise(col("severity") == OPEN)
    rules = ledger.groupBy("verifier", "rule").agg(
        F.count_if((col("auth_state") == "unknown") & col("rule").isin(*READS_AUTH)).alias("blind"), F.count_if((col("confidence") < 0.9) & col("contradiction") & (col("severity") == "high")).alias("weak"),
        F.count_if(~fits).alias("unfit"), F.count_if("contradiction").alias("n"),
    ).withColumn("all", F.sum("n").over(Window.partitionBy("verifier")))
    n = rules.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("blind", "weak", "unfit")), F.round(F.max(F.when(col("n") > 0, col("n") / col("all"))), 6).alias("share"))
    state = lambda ok: F.when(F.coalesce(ok, F.lit(True)), "PASS").otherwise("FAIL")
    named = {"authentication without a verdict": "blind", "weak claims that weigh high": "weak", "severity against verdict": "unfit"}
    rows = ((F.lit(name), col(c), state(col(c) == 0)) for name, c in named.items())
    return _side_by_side(n, *rows, (F.lit("largest share of a rule"), col("share"), state(col("share") <= dominant)), names=("check", "value", "status"))
