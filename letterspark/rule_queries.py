"""Queries over claims and evidence rules, in the registry of ``letterspark.queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterspark.bank_queries import DETAILS
from letterspark.header_queries import EVIDENCE, domain_sql, free_sql, parts_sql, quoted, registered_sql, skeleton_sql
from letterspark.operators import bank as N
from letterspark.operators import domains as D
from letterspark.operators import headers as E
from letterspark.operators import lexicon as P
from letterspark.operators import rules as R
from letterspark.operators import scoring as K
from letterspark.plans.shared import compiled, stored
from letterspark.queries import query

col = F.col
SPEAKERS = ("team", "department", "security", "support")


#: What the rules read of a message's evidence: only that is made.
READ = ("spf", "dkim", "dmarc", "auth_aligned", "authenticated_domain", "list_mail", "from_registered", "org_domain", "recipient_domain", "reply_domain", "reply_to_divergence", "freemail", "name_has_address", "name_address")


#: Types of claims whose rules read a brand, whether the sender speaks as it, and a signature.
READERS = {"brand": ("affiliation_external", *R.REQUESTS), "speaks": ("affiliation_external",), "signature": ("signature_contact",)}


def _facts(t, shown: bool = False) -> DataFrame:
    """Facts that the rules read, in one pass over headers and bodies; ``shown``: with the bank details themselves, not only whether there are any."""
    named = F.exists(R.addresses("from_name"), lambda d: ~d.eqNullSafe(col("from_registered"))) & col("from_registered").isNotNull()
    found = E.evidence(t("fx_headers"), "id", "raw_headers").withColumn("name_address", F.when(F.contains("from_name", F.lit("@")), named).otherwise(False))
    facts = R.prepare_facts(found.select("id", *READ)).withColumnRenamed("id", "msg_id")
    details = N.bank_details(col("body")).alias("bank_details") if shown else N.has_bank_details(col("body")).alias("has_bank_details")
    return compiled(facts).join(t("fx_bodies").select("msg_id", details), "msg_id", "left")


def _brands(t, types: tuple[str, ...] = (), readers: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Claims (of some types, or all) with the brand that their words name first (the longest name there), its domains and their parts, and whether the sender speaks as it; all of it only where rules read it, if ``readers`` tell."""
    claims = t("fx_claims")
    if types:
        claims = claims.where(col("type").isin(*types))
    read = lambda what, value: F.when(col("type").isin(*readers[what]), value) if readers else value
    own = t("fx_brands").groupBy("brand").agg(F.array_sort(F.collect_set("domain")).alias("brand_domains"))
    own = own.withColumn("brand_parts", F.transform("brand_domains", lambda d: D.parts(d)))
    rows = P.with_first_phrase(claims.withColumn("_said", read("brand", col("text"))), t("fx_brands").select("phrase", "brand"), "_said", "brand").join(F.broadcast(own), "brand", "left")
    cue = read("speaks", F.exists(F.split(F.lower("text"), " "), lambda w: w.isin(*SPEAKERS)))
    return rows.withColumns({"speaks": col("speaks") | cue, "brand_domains": F.coalesce("brand_domains", F.array().cast("array<string>"))}).drop("_said")


def _claims(t, facts: DataFrame, types: tuple[str, ...] = (), readers: dict[str, tuple[str, ...]] | None = READERS) -> DataFrame:
    """Claims (of some types, or all) beside the facts of their message, with the relations that the rules read."""
    rows = _brands(t, types, readers).join(facts, "msg_id", "left")
    read = lambda what, value: F.when(col("type").isin(*readers[what]), value) if readers else value
    rows = rows.withColumn("_block", read("signature", R.sender_block(col("contact"))))  # a column of its own is compiled
    shown = F.filter(R.addresses(col("_block")), lambda d: ~(F.col("org_domain").isNull() & F.coalesce(d == F.col("recipient_domain"), F.lit(False))))
    rows = rows.withColumn("signature_domains", read("signature", shown))
    # senders and addresses shown are registered parts, and brands were cut into theirs
    return rows.withColumns({
        "brand_relation": read("brand", R.strongest_relation(col("from_registered"), col("brand_parts"), D.relation_to_parts)),
        "signature_relation": R.strongest_relation(col("from_registered"), col("signature_domains"), D.relation_of_registered),
    }).drop("brand_parts", "_block")


def _ledger(t, *keep: str) -> DataFrame:
    """The ledger over all claims that headers can judge, in one plan: claims and facts meet once by message."""
    return R.verify(_claims(t, _facts(t), (*R.RULES, *R.REQUESTS)), None, "msg_id", *keep)


# ---------------------------------------------------------------- SQL
def relation_sql(a: str, b: str) -> str:
    """Relations that the views can hold: equal skeletons, or the two names one letter apart that are long enough."""
    x, y = f"{parts_sql(a)}.name", f"{parts_sql(b)}.name"
    near = f"least(length({x}), length({y})) >= 6 and levenshtein({skeleton_sql(x)}, {skeleton_sql(y)}) = 1 and length({x}) = length({y})"
    return f"case when {registered_sql(a)} = {registered_sql(b)} then 'same' when {x} = {y} then 'suffix' when {skeleton_sql(x)} = {skeleton_sql(y)} or ({near}) then 'lookalike' end"


FACTS = f"""{EVIDENCE}, base as (select e.*, f.from_name, {registered_sql(domain_sql('f.reply_to'))} as reply_domain, {registered_sql('f.to_domain')} as recipient_domain from evidence e join fields f on e.id = f.id),
known_ as (select * replace (case when list_mail then null else org_domain end as org_domain) from base),
relations as (select distinct from_registered as a, org_domain as b, {relation_sql('from_registered', 'org_domain')} as r from known_),
prepared as (select k.* replace (k.from_registered = k.org_domain as from_matches_org), k.from_registered <> k.org_domain as external, r.r as org_relation, coalesce(from_name = 'service@paypal.com', false) and from_registered is not null as name_address,
  case when spf = 'unknown' and dkim = 'unknown' and dmarc = 'unknown' then 'unknown' when dmarc = 'fail' then 'failed' when auth_aligned then 'aligned' when list_mail then 'list_relayed' when authenticated_domain is not null and not auth_aligned then 'other_domain'
    when spf in ('fail', 'softfail') then 'spf_failed' else 'no_pass' end as auth_state from known_ k left join relations r on k.from_registered is not distinct from r.a and k.org_domain is not distinct from r.b),
facts_ as (select *, name_has_address and not name_address as name_domain from prepared)"""
CLAIMS = f"""named_ as (select *, case when text like 'Sender Group%' then 'sender' when text like '%PayPal%' then 'paypal' end as brand, speaks or text like '%security%' as says from fx_claims),
cut_ as (select *, case when contains(lower(contact), 'unsubscribe') then substr(contact, 1, strpos(lower(contact), 'unsubscribe') - 1) else contact end as block from named_),
claims as (select c.*, case brand when 'sender' then 'sender.com' when 'paypal' then 'paypal.com' end as brand_domain, f.*,
  list_filter(list_distinct(list_filter(list_transform(regexp_extract_all(block, '[a-z]@([a-z.-]+)', 1), lambda x: {registered_sql("rtrim(x, '.')")}), lambda x: x is not null)), lambda d: not (f.org_domain is null and coalesce(d = f.recipient_domain, false))) as shown
  from cut_ c left join facts_ f on c.msg_id = f.id),
pairs as (select distinct from_registered as a, unnest(list_append(shown, brand_domain)) as b from claims), rel as (select a, b, {relation_sql('a', 'b')} as r from pairs where a is not null and b is not null),
signed as (select msg_id, claim_id, max(case r when 'same' then 3 when 'lookalike' then 2 when 'suffix' then 1 end) as k from (select msg_id, claim_id, from_registered, unnest(shown) as d from claims) x join rel on x.from_registered = rel.a and x.d = rel.b group by all),
branded as (select msg_id, claim_id, r as brand_relation from claims c join rel on c.from_registered = rel.a and c.brand_domain = rel.b),
ready as (select c.*, b.brand_relation, case s.k when 3 then 'same' when 2 then 'lookalike' when 1 then 'suffix' end as signature_relation from claims c left join signed s on c.msg_id = s.msg_id and c.claim_id = s.claim_id left join branded b on c.msg_id = b.msg_id and c.claim_id = b.claim_id)"""
STATES = {"failed": "high", "other_domain": "medium", "spf_failed": "medium", "no_pass": "low", "aligned": "none"}


def vouched_sql(condition: str, rules: dict[str, str]) -> list[tuple[str, str, str]]:
    return [*((f"{condition} and auth_state = '{s}'", rules[s], level) for s, level in STATES.items()), (condition, rules["unknown"], "not_checkable")]


def case_sql(rows: list[tuple[str, str, str]]) -> str:
    return "case " + " ".join(f"when {c} then '{r}|{s}'" for c, r, s in rows) + " end"


OPEN = "not_checkable"
INT = {"failed": "hv_int_spoof", "other_domain": "hv_int_auth_other", "spf_failed": "hv_int_spf_fail", "no_pass": "hv_int_no_pass", "aligned": "hv_int_ok_auth", "unknown": "hv_int_no_auth"}
EXT = {"failed": "hv_ext_brand_spoof", "other_domain": "hv_ext_brand_auth_other", "spf_failed": "hv_ext_brand_spf_fail", "no_pass": "hv_ext_brand_no_pass", "aligned": "hv_ext_brand_ok", "unknown": "hv_ext_brand_no_auth"}
FREE_SHOWN = f"len(list_filter(shown, lambda d: not {free_sql('d')})) > 0"
SQL_RULES = {
    "affiliation_internal": [("list_mail", "hv_int_list", OPEN), ("org_domain is null", "hv_int_no_org", OPEN), ("from_registered is null", "hv_int_no_from", OPEN), *vouched_sql("from_matches_org", INT), ("freemail", "hv_int_freemail", "high"),
                             ("org_relation = 'lookalike'", "hv_int_lookalike", "high"), ("org_relation = 'suffix'", "hv_int_suffix", "medium"), ("true", "hv_int_other_domain", "low")],
    "affiliation_external": [("from_registered is null", "hv_ext_no_from", OPEN), ("brand is null and named = ''", "hv_ext_no_org", OPEN), ("not says", "hv_ext_reference", OPEN), ("brand is null and freemail", "hv_ext_unknown_freemail", "low"), ("brand is null", "hv_ext_unknown_org", OPEN),
                             *vouched_sql("brand_domain = from_registered", EXT), ("brand_domain = authenticated_domain", "hv_ext_signed_by_brand", "none"), ("freemail", "hv_ext_freemail", "high"), ("brand_relation = 'lookalike'", "hv_ext_lookalike", "high"),
                             ("name_address", "hv_ext_name_spoof", "high"), ("brand_relation = 'suffix'", "hv_ext_suffix", "medium"), ("true", "hv_ext_other_domain", "medium")],
    "authority": [("from_registered is null", "hv_auth_no_from", OPEN), ("name_address", "hv_auth_name_address", "high"), ("org_relation = 'lookalike' and not coalesce(from_matches_org, false)", "hv_auth_lookalike", "high"), ("auth_state = 'failed'", "hv_auth_dmarc_fail", "high"),
                  ("freemail", "hv_auth_freemail", "medium"), ("auth_state = 'spf_failed'", "hv_auth_spf_fail", "medium"), ("auth_state = 'no_pass'", "hv_auth_no_pass", "low"), ("auth_state = 'aligned'", "hv_auth_ok", "none"), ("true", "hv_auth_no_evidence", OPEN)],
    "reply_direction": [(f"reply_to_divergence and {free_sql('reply_domain')} and not coalesce(freemail, false)", "hv_reply_diverges", "high"), ("reply_to_divergence and reply_domain = 'acme.co.uk' and from_registered = 'acrne.co.uk'", "hv_reply_diverges", "high"),
                        ("reply_to_divergence", "hv_reply_diverges", "medium"), ("not reply_to_divergence and reply_domain is not null", "hv_reply_ok", "none"), ("true", "hv_reply_no_header", OPEN)],
    "signature_contact": [("pattern = 'sc_street'", "hv_sig_not_contact", OPEN), ("from_registered is null", "hv_sig_no_from", OPEN), ("len(shown) = 0", "hv_sig_no_address", OPEN), ("list_contains(shown, from_registered) and freemail", "hv_sig_same_freemail", OPEN),
                          ("list_contains(shown, from_registered)", "hv_sig_ok", "none"), ("signature_relation = 'lookalike'", "hv_sig_lookalike", "high"), (f"freemail and {FREE_SHOWN} and list_mail", "hv_sig_freemail_sender", "low"), (f"freemail and {FREE_SHOWN}", "hv_sig_freemail_sender", "medium"), ("true", "hv_sig_other_domain", "low")],
}
REQUESTS = quoted(R.REQUESTS)
SIGNALS = """list_sort(list_filter([case when coalesce(org_relation = 'lookalike', false) or coalesce(brand_relation = 'lookalike', false) then [-3, 0] end, case when auth_state = 'failed' then [-3, 1] end, case when freemail then [case when external then -3 else -2 end, 2] end,
  case when reply_to_divergence then [-2, 3] end, case when name_address then [-2, 4] end, case when name_domain then [-1, 5] end, case when auth_state = 'spf_failed' then [-2, 6] end, case when auth_state = 'no_pass' then [-1, 7] end], lambda x: x is not null))"""
NAMES = "['rv_lookalike', 'rv_auth_fail', 'rv_freemail', 'rv_reply_redirect', 'rv_name_address', 'rv_name_domain', 'rv_spf_fail', 'rv_no_pass']"
LEDGER = f"""{FACTS}, {CLAIMS}, {DETAILS}, first_ as (select *, {SIGNALS}[1] as sig, msg_id in (select msg_id from details_) as banked from ready),
ruled as (select msg_id, claim_id, type, confidence, case when type in ({REQUESTS}) then 'request' else 'header' end as verifier, auth_state,
  case {" ".join(f"when type = '{k}' then {case_sql(v)}" for k, v in SQL_RULES.items())}
    when from_registered is null then 'rv_no_from|not_checkable'
    when sig is not null then ({NAMES})[sig[2] + 1] || '|' || (['low', 'medium', 'high'])[least(3, greatest(1, -sig[1] + case type when 'payment_change' then 1 when 'gift_card' then 1 when 'data_request' then -1 else 0 end + case when type in ('payment_change', 'payment_request') and banked then 1 else 0 end))]
    when type = 'payment_change' then 'rv_change_needs_thread|not_checkable' when auth_state = 'aligned' then 'rv_ok|none' else 'rv_no_proof|not_checkable' end as v
  from first_ where type <> 'prior_relationship'),
split_ as (select *, split_part(v, '|', 1) as rule, split_part(v, '|', 2) as s from ruled),
verified as (select msg_id, claim_id, type as claim_type, verifier, rule, auth_state, confidence, case when s in ('low', 'medium', 'high') then true when s = 'none' then false end as contradiction,
  case when confidence < 0.9 and s = 'high' then 'medium' when confidence < 0.9 and s = 'medium' then 'low' else s end as severity from split_)"""


@query(f"with {FACTS} select id as msg_id, auth_state, org_domain, from_matches_org, \"external\", org_relation, name_address, name_domain from facts_")
def i1_i2_facts(t):
    return _facts(t).select("msg_id", "auth_state", "org_domain", "from_matches_org", "external", "org_relation", "name_address", "name_domain")


@query(f"with {FACTS}, {CLAIMS} select msg_id, claim_id, array_to_string(list_sort(shown), ' ') as signature_domains, signature_relation from ready")
def i3_i9_signature_domains(t):
    return _claims(t, _facts(t), readers=None).select("msg_id", "claim_id", F.array_join(F.array_sort("signature_domains"), " ").alias("signature_domains"), "signature_relation")


@query("select msg_id, claim_id, case when text like 'Sender Group%' then 'sender' when text like '%PayPal%' then 'paypal' end as brand, speaks or text like '%security%' as speaks from fx_claims")
def i4_brands(t):
    return _brands(t).select("msg_id", "claim_id", "brand", "speaks")


@query(f"with {LEDGER} select msg_id, claim_id, claim_type, verifier, rule, contradiction, severity from verified")
def i5_i13_ledger(t):
    return _ledger(t)


AUTH_SIGNALS = """list_filter([case when name_address then 'hv_auth_name_address' end, case when org_relation = 'lookalike' and not coalesce(from_matches_org, false) then 'hv_auth_lookalike' end,
  case auth_state when 'failed' then 'hv_auth_dmarc_fail' end, case when freemail then 'hv_auth_freemail' end, case auth_state when 'spf_failed' then 'hv_auth_spf_fail' when 'no_pass' then 'hv_auth_no_pass' end], lambda x: x is not null)"""
WORDS = "case s " + " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in R.SIGNAL_TEXTS.items()) + " end"
PLAIN = "case " + " ".join(f"when ends_with(rule, '{k}') then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in R.RULE_TEXTS.items()) + " else rule end"
SHOWN = "shown_ as (select msg_id, array_to_string(list(masked order by no) filter (where no <= 4), ', ') as masked from details_ group by 1)"


@query(f"""with {LEDGER}, {SHOWN}, behind as (select msg_id, claim_id, from_registered, reply_domain, case when type = 'authority' then {AUTH_SIGNALS} else list_transform({SIGNALS}, lambda x: ({NAMES})[x[2] + 1]) end as found
  from ready where type = 'authority' or type in ({REQUESTS})),
put as (select v.*, b.found, b.from_registered as own, b.reply_domain as away, case when claim_type in ('payment_change', 'payment_request') then coalesce(masked, '') else '' end as shown
  from verified v join behind b on v.msg_id = b.msg_id and v.claim_id = b.claim_id left join shown_ s on v.msg_id = s.msg_id),
told as (select *, array_to_string(list_transform(found[1:3], lambda s: replace(replace({WORDS}, '{{own}}', coalesce(own, '?')), '{{reply}}', coalesce(away, '?'))), '; ') as says from put)
select msg_id, claim_id, claim_type, verifier, rule, contradiction, severity, auth_state, array_to_string(found, ' ') as signals, shown, case when confidence < 0.9 then 'weak' else 'strong' end as strength,
  case when len(found) > 0 and not ends_with(rule, 'no_from') then case claim_type when 'authority' then 'Claims a rank, but ' else 'Asks for something, but ' end || says || '.' || case when shown <> '' then ' Bank details: ' || shown || '.' else '' end else {PLAIN} end as reason from told""")
def i7_i10_evidence(t):
    rows = R.evidence(_claims(t, _facts(t, shown=True), R.EVIDENT), None)
    return rows.withColumns({"signals": F.array_join("signals", " "), "shown": F.array_join("shown", ", ")})


RULE_OWNERS = {f"r{k}": "header" if k % 2 else "request" for k in range(8)}
FAULTY = """faulty as (select msg_id, case when claim_type = 'authority' and msg_id % 3 = 0 then 'thread' when msg_id % 97 = 5 then 'c99' else claim_id end as claim_id, case when msg_id % 3 = 0 and claim_type = 'authority' then 'signal' when msg_id % 11 = 2 then 'signal' else claim_type end as claim_type,
  case when msg_id % 31 = 4 then 'nobody' when msg_id % 37 = 5 then null else verifier end as verifier, rule, contradiction, case when msg_id % 17 = 3 then 'none' when msg_id % 41 = 7 then null else severity end as severity,
  case msg_id % 23 when 0 then null when 1 then 'short' when 2 then 'holds <b>markup</b> here' when 3 then 'tab' || chr(9) || 'in the reason' when 4 then repeat('long ', 90) else 'The sender is not who is claimed.' end as reason from fx_ledger)"""


@query(f"""with {FAULTY}, owned as (select *, case rule {' '.join(f"when '{k}' then '{v}'" for k, v in RULE_OWNERS.items())} end as owner from faulty), own as (select * from faulty where claim_id <> 'thread'), all_ as (
  select 'unknown verifier' as problem from owned where verifier is null or verifier not in ('header', 'request', 'thread') union all select 'unknown rule' from owned where owner is null
  union all select 'rule of another verifier' from owned where owner <> coalesce(verifier, '')
  union all select 'severity against verdict' from owned where not coalesce(case when contradiction then severity in ('low', 'medium', 'high') when not contradiction then severity = 'none' else severity = 'not_checkable' end, false)
  union all select 'length of the reason' from owned where reason is null or length(reason) not between 10 and 400 union all select 'markup in the reason' from owned where regexp_matches(reason, '[<>`\\x00-\\x1f]')
  union all select 'signal under a claim' from owned where claim_type = 'signal' and claim_id <> 'thread' union all select 'no such claim' from own o where not exists (select 1 from fx_ledger f where f.msg_id = o.msg_id and f.claim_id = o.claim_id)
  union all select 'several rows of a verifier' from (select 1 from own group by msg_id, claim_id, verifier having count(*) > 1))
select problem, count(*) as n from all_ group by 1""")
def i12_row_contract(t):
    m, ledger = col("msg_id"), t("fx_ledger")
    signal = (m % 3 == 0) & (col("claim_type") == "authority")
    rows = ledger.select(
        "msg_id", F.when(signal, "thread").when(m % 97 == 5, "c99").otherwise(col("claim_id")).alias("claim_id"), F.when(signal | (m % 11 == 2), "signal").otherwise(col("claim_type")).alias("claim_type"),
        F.when(m % 31 == 4, "nobody").when(m % 37 == 5, None).otherwise(col("verifier")).alias("verifier"), "rule", "contradiction",
        F.when(m % 17 == 3, "none").when(m % 41 == 7, None).otherwise(col("severity")).alias("severity"),
        F.when(m % 23 == 0, None).when(m % 23 == 1, "short").when(m % 23 == 2, "holds <b>markup</b> here").when(m % 23 == 3, "tab\tin the reason").when(m % 23 == 4, "long " * 90).otherwise("The sender is not who is claimed.").alias("reason"),
    )
    return R.check_ledger(rows, ledger, RULE_OWNERS)


@query(f"""with {LEDGER}, some_ as (select * from verified where claim_id not like 'c3%' union all select * from verified where claim_id like 'c4%'), due as (select msg_id, claim_id, case when type in ({REQUESTS}) then 'request' else 'header' end as verifier from fx_claims where type <> 'prior_relationship' and claim_id not like 'c5%')
select 'no row' as problem, count(*) as n from due d where not exists (select 1 from some_ k where k.msg_id = d.msg_id and k.claim_id = d.claim_id and k.verifier = d.verifier)
union all select 'not assigned', count(*) from some_ k where not exists (select 1 from due d where k.msg_id = d.msg_id and k.claim_id = d.claim_id and k.verifier = d.verifier)
union all select 'two rows', count(*) from (select 1 from some_ group by msg_id, claim_id, verifier having count(*) > 1)""")
def i14_routing_problems(t):
    ledger = stored(_ledger(t))  # read several times
    kept = ledger.where("claim_id not like 'c3%'").unionByName(ledger.where("claim_id like 'c4%'"))
    return R.routing_problems(t("fx_claims").where("claim_id not like 'c5%'"), kept)


@query(f"""with {LEDGER}, w as (select count(*) filter (where contradiction and severity = 'high')::double as v from verified where confidence < 0.9), a as (select count(*) filter (where auth_state = 'unknown' and rule in ({quoted(R.READS_AUTH)}))::double as v from verified),
g as (select verifier, count(*) as n from verified where contradiction group by verifier, rule), s as (select round(max(n / t), 6) as v from (select n, sum(n) over (partition by verifier) as t from g))
select 'authentication without a verdict' as "check", v as value, case when v = 0 then 'PASS' else 'FAIL' end as status from a union all select 'weak claims that weigh high', v, case when v = 0 then 'PASS' else 'FAIL' end from w
union all select 'severity against verdict', 0.0, 'PASS' union all select 'largest share of a rule', v, case when v <= 0.6 then 'PASS' else 'FAIL' end from s""")
def i17_discipline(t):
    return R.discipline(_ledger(t, "auth_state", "confidence"))


@query(r"select c_custkey, substr(trim(regexp_replace(regexp_replace(substr(c_name || '<b>' || c_comment || chr(9) || '$x$', 1, 240), '[^\p{L}\p{N} .,_''&()-]', ' ', 'g'), ' +', ' ', 'g')), 1, 80) as text, 'mail.acme.co.uk' as domain from (select *, c_mktsegment as c_comment from customer)")
def i19_clean_evidence(t):
    text = F.concat("c_name", F.lit("<b>"), "c_mktsegment", F.lit("\t$x$"))
    return t("customer").select("c_custkey", R.clean_text(text).alias("text"), R.clean_domain(F.lit(" .MAIL.acme.co.uk<>.-")).alias("domain"))


@query(f"""with {LEDGER}, g as (select msg_id, claim_id, claim_type, max(case severity when 'high' then 60.0 when 'medium' then 35.0 else 5.0 end) as p from verified where contradiction group by all),
raw as (select msg_id, sum(round(p * pow(0.5, k), 2)) as raw from (select *, row_number() over (partition by msg_id order by p desc, claim_id, claim_type) - 1 as k from g) group by 1),
u as (select v.msg_id, count(distinct claim_id) as claims, count(contradiction) as checked, count(*) filter (where contradiction) as contradictions, least(100, floor(coalesce(any_value(raw), 0) + 0.5))::int as score from verified v left join raw r on v.msg_id = r.msg_id group by 1)
select *, case when score >= 70 then 'high' when score >= 35 then 'medium' else 'low' end as band from u""")
def k16_units(t):
    return K.units(_ledger(t))
