"""Queries over coverage, flat vectors, scored cases and false alarms, in the registry of ``letterspark.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.header_queries import EVIDENCE
from letterspark.operators import compare as X
from letterspark.operators import headers as E
from letterspark.operators import scoring as K
from letterspark.operators import threads as J
from letterspark.queries import query
from letterspark.sources import records as A
from letterspark.thread_queries import LEDGER

col = F.col
#: The ledger with every third message's rows on authority as signals of its thread.
SIGNALS = """select msg_id, case when claim_type = 'authority' and msg_id % 3 = 0 then 'thread' else claim_id end as claim_id, case when claim_type = 'authority' and msg_id % 3 = 0 then case when rule in ('r1', 'r4') then 'single_email' else 'sending_path' end else claim_type end as claim_type,
  case when claim_type = 'authority' and msg_id % 3 = 0 then 'thread' else verifier end as verifier, rule, contradiction, severity from fx_ledger"""
CODES = ("no_from", "odd_code", "single_email", "text_truncated")
LIMITED = f"limits_ as (select o_orderkey as msg_id, unnest([{', '.join(f'case when o_orderkey % {k} = 0 then ' + chr(39) + c + chr(39) + ' end' for k, c in enumerate(CODES, 2))}]) as code from orders)"
FOUND = "found_ as (select distinct msg_id, claim_id from fx_ledger where msg_id % 19 <> 4)"
TEXTS = "case code " + " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in K.LIMITS.items()) + " end"
REPORT = f"""signals_ as ({SIGNALS}), {LIMITED}, {FOUND},
status_ as (select s.msg_id, s.claim_id, bool_or(contradiction) as s from signals_ s join found_ f on s.msg_id = f.msg_id and s.claim_id = f.claim_id where s.claim_id <> 'thread' group by all),
claims_ as (select msg_id, count(*) as claims, count(s) as checked, count(*) filter (where s) as contradicted, count(*) filter (where not s) as consistent, count(*) filter (where s is null) as not_checkable from status_ group by 1),
history_ as (select msg_id, count(*) as signals, count(*) filter (where contradiction) as signals_contradicted, count(*) filter (where contradiction is null) as signals_not_checkable, count(*) filter (where claim_type <> 'single_email') as h, count(contradiction) filter (where claim_type <> 'single_email') as ran from signals_ where claim_id = 'thread' group by 1),
why_ as (select msg_id, string_agg(code, ',' order by code) as limits, string_agg(' ' || {TEXTS}, '' order by code) as told from limits_ where code is not null and code <> 'odd_code' group by 1),
report_ as (select o.o_orderkey as msg_id, coalesce(claims, 0) as claims, coalesce(checked, 0) as checked, coalesce(contradicted, 0) as contradicted, coalesce(consistent, 0) as consistent, coalesce(not_checkable, 0) as not_checkable, coalesce(signals, 0) as signals,
  coalesce(signals_contradicted, 0) as signals_contradicted, coalesce(signals_not_checkable, 0) as signals_not_checkable, coalesce(limits, '') as limits,
  case when coalesce(claims, 0) = 0 then 'No claim that can be checked was found.' else checked || ' of ' || claims || ' claims could be checked.' end || case when h > 0 then ' ' || ran || ' of ' || h || ' checks against the thread ran.' else '' end || coalesce(told, '') as note
  from orders o left join claims_ c on o.o_orderkey = c.msg_id left join history_ h on o.o_orderkey = h.msg_id left join why_ w on o.o_orderkey = w.msg_id)"""


def _ledger(t):
    signal = (col("claim_type") == "authority") & (col("msg_id") % 3 == 0)
    kind = F.when(col("rule").isin("r1", "r4"), "single_email").otherwise("sending_path")
    return t("fx_ledger").withColumns({"claim_id": F.when(signal, "thread").otherwise(col("claim_id")), "verifier": F.when(signal, "thread").otherwise(col("verifier")), "claim_type": F.when(signal, kind).otherwise(col("claim_type"))})


def _report(t):
    k = col("o_orderkey")
    codes = F.array_compact(F.array(*(F.when(k % m == 0, c) for m, c in enumerate(CODES, 2))))
    limits = t("orders").select(k.alias("msg_id"), F.explode(codes).alias("code"))
    return K.coverage_report(t("orders").select(k.alias("msg_id")), _ledger(t), t("fx_ledger").where("msg_id % 19 <> 4"), limits)


@query(f"with {REPORT} select * from report_")
def k5_coverage_report(t):
    return _report(t).withColumn("limits", F.array_join("limits", ","))


RULES, VERIFIERS, TACTICS = [f"r{k}" for k in range(9)], ["header", "request", "thread"], ["error", "purchase", "view"]
NAMES = [f"rule_{r}" for r in RULES] + [f"worst_{v}" for v in VERIFIERS] + [f"tactic_{x}" for x in TACTICS] + ["claims_found", "claims_checked"]


@query(f"""with {REPORT}, flags as (select msg_id, {', '.join(f"count(*) filter (where contradiction and rule = '{r}') > 0 as rule_{r}" for r in RULES)},
  {', '.join(f"max(case when contradiction and verifier = '{v}' then case severity when 'high' then 3 when 'medium' then 2 else 1 end else 0 end) as worst_{v}" for v in VERIFIERS)} from signals_ group by 1),
chances as (select user_id as msg_id, {', '.join(f"max(value / 100) filter (where event_type = '{x}') as tactic_{x}" for x in TACTICS)} from events group by 1)
select r.msg_id, {', '.join(f"coalesce({n}, false)::int as {n}" if n.startswith("rule") else f"coalesce({n}, 0) as {n}" for n in NAMES[:-2])}, claims as claims_found, checked as claims_checked
from report_ r left join flags f on r.msg_id = f.msg_id left join chances c on r.msg_id = c.msg_id""")
def k6_feature_vectors(t):
    chances = t("events").select(col("user_id").alias("msg_id"), col("event_type").alias("tactic"), (col("value") / 100).alias("p"))
    found = X.feature_vectors(t("orders").select(col("o_orderkey").alias("msg_id")), _ledger(t), RULES, VERIFIERS, chances, TACTICS, _report(t))
    return found.select("msg_id", *(F.get("features", F.lit(k)).alias(n) for k, n in enumerate(NAMES)))


POINTS = "case severity when 'high' then 60.0 when 'medium' then 35.0 else 5.0 end"


def _scored_sql(name: str, where: str) -> str:
    return f"""{name}_g as (select msg_id, claim_id, claim_type, max({POINTS}) as p from signals_ where contradiction and {where} group by all),
{name}_r as (select msg_id, sum(round(p * pow(0.5, k), 2)) as raw from (select *, row_number() over (partition by msg_id order by p desc, claim_id, claim_type) - 1 as k from {name}_g) group by 1)"""


CASES = f"""signals_ as ({SIGNALS}), {_scored_sql('full', 'true')}, {_scored_sql('without', "verifier <> 'thread'")},
cases_ as (select o_orderkey as msg_id, o_custkey as thread, case o_orderstatus when 'F' then 'test' else 'validation' end as split, 'v' || o_orderkey % 4 as variant, case when o_orderkey % 4 < 3 then 1 else 0 end as label,
  least(100, floor(coalesce(f.raw, 0) + 0.5))::int as score_full, least(100, floor(coalesce(w.raw, 0) + 0.5))::int as score_without from orders o left join full_r f on o.o_orderkey = f.msg_id left join without_r w on o.o_orderkey = w.msg_id)"""


def _cases(t):
    k = col("o_orderkey")
    cases = t("orders").select(
        k.alias("msg_id"), col("o_custkey").alias("thread"), F.when(col("o_orderstatus") == "F", "test").otherwise("validation").alias("split"), F.concat(F.lit("v"), k % 4).alias("variant"), (k % 4 < 3).cast("int").alias("label"),
    )
    return K.scored_both(cases, _ledger(t))


@query(f"with {CASES} select msg_id, split, variant, label, score_full, case when score_full >= 70 then 'high' when score_full >= 35 then 'medium' else 'low' end as band_full, score_without, case when score_without >= 70 then 'high' when score_without >= 35 then 'medium' else 'low' end as band_without from cases_")
def k13_scored_cases(t):
    return _cases(t).drop("thread")


@query(f"""with {CASES}, all_ as (select * from cases_ union all select * replace ('attacks' as variant) from cases_ where label = 1), m as (select split, variant, unnest(['some_full', 'high_full', 'some_without', 'high_without']) as metric, unnest([score_full >= 35, score_full >= 70, score_without >= 35, score_without >= 70]) as hit from all_)
select split, variant, metric, count(*) as n, count(*) filter (where hit) as hits, round(count(*) filter (where hit) / count(*), 6) as rate from m group by all""")
def k13_case_table(t):
    return K.case_table(_cases(t), ["split"], "thread").drop("low", "high")


THREADS = "threads_ as (select distinct thread_id, case thread_id % 5 when 0 then 'test' else 'train' end as split, 's' || thread_id % 3 as source from fx_messages)"
MESSAGES = f"""{LEDGER}, {THREADS}, per_ as (select msg_key, thread_id, split, source, max(case when contradiction then case severity when 'high' then 3 when 'medium' then 2 else 1 end else 0 end) as worst, count(*) filter (where claim_type = 'single_email') = 0 as past from ledger join threads_ using (thread_id) group by all)"""


def _threads(t):
    k = col("thread_id")
    return t("fx_messages").select(k, F.when(k % 5 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("s"), k % 3).alias("source")).distinct()


@query(f"""with {MESSAGES}, flips as (select distinct thread_id from ledger where contradiction and position >= 2 and severity in ('medium', 'high')), t as (select split, source, thread_id, count(*) as messages, count(*) filter (where past) as judged, count(*) filter (where past and worst >= 2) as flagged_messages, count(*) filter (where worst = 3) as high_messages from per_ group by all)
select split, source, sum(messages) as messages, sum(judged) as judged, sum(flagged_messages) as flagged_messages, sum(high_messages) as high_messages, count(*) as threads, count(*) filter (where flagged_messages > 0) as flagged_threads, count(*) filter (where thread_id in (select thread_id from flips)) as flips from t group by all""")
def j19_thread_rates(t):
    return J.thread_rates(J.signal_ledger(t("fx_messages")), _threads(t))


@query(f"with {LEDGER}, {THREADS} select split, source, rule, claim_type as signal, count(*) as rows, count(*) filter (where contradiction) as contradiction, count(*) filter (where not contradiction) as consistent, count(*) filter (where contradiction is null) as not_checkable from ledger join threads_ using (thread_id) group by all")
def j19_rule_rates(t):
    return J.rule_rates(J.signal_ledger(t("fx_messages")), _threads(t))


WILSON = "(a / n + {s} 1.959963984540054 * sqrt((a / n) * (1 - a / n) / n + 1.959963984540054 * 1.959963984540054 / (4 * n * n)) + 1.959963984540054 * 1.959963984540054 / (2 * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n)"


@query(f"""with {MESSAGES}, g as (select split, source, count(distinct thread_id) as threads, count(*)::double as n, count(*) filter (where worst >= 2)::double as a from per_ where past group by all)
select split, source, threads, n::bigint as messages, a::bigint as flagged, round(a / n, 6) as rate, round({WILSON.format(s='-')}, 6) as wilson_low, round({WILSON.format(s='')}, 6) as wilson_high from g""")
def l18_false_alarms(t):
    return J.false_alarms(J.signal_ledger(t("fx_messages")), _threads(t))[0].drop("low", "high")


@query(f"""with {MESSAGES}, n as (select split, source, count(*) as messages from per_ where past group by all), h as (select p.split, p.source, l.rule, l.claim_type as signal, count(distinct l.msg_key) as messages_flagged from ledger l join per_ p on l.msg_key = p.msg_key where p.past and l.contradiction and l.severity in ('medium', 'high') group by all)
select h.*, messages, round(messages_flagged / messages, 6) as rate from h join n on h.split = n.split and h.source = n.source""")
def l18_false_alarm_rules(t):
    return J.false_alarms(J.signal_ledger(t("fx_messages")), _threads(t))[1]


BODY = "coalesce(trim(b.body), '')"


@query(f"""with {EVIDENCE} select e.id as key, f.source, f.message_id, f.in_reply_to, f.refs as "references", f.from_addr, f.from_name, e.from_registered as from_domain, coalesce(f.subject, '') as subject, f.sent, e.origin_ip, f.mailer, e.received_hops, e.list_mail,
  {BODY} as text, '' as quoted, {BODY} as "full", {BODY} as redacted, e.spf, e.auth_aligned, e.org_domain from evidence e join fields f on e.id = f.id join fx_bodies b on e.id = b.msg_id""")
def a10_message_records(t):
    rows = t("fx_headers").join(t("fx_bodies").select(col("msg_id").alias("id"), "body"), "id")
    parsed = rows.where("id % 2 = 1")
    evidence = E.evidence(parsed, "id", "raw_headers", "raw_headers", "source", "body").drop("from_name", "send_hour")
    table = E.fields(evidence, "id", "raw_headers", *(c for c in evidence.columns if c not in ("id", "raw_headers")))
    cell = F.when(col("id") % 4 == 1, F.array_join("references", " ")).when(F.size("references") > 0, F.to_json("references"))
    both = A.union_records(A.from_blocks(rows.where("id % 2 = 0 or id % 5 = 0")), A.from_table(table.withColumn("references", cell)))
    return both.select("*", "facts.spf", "facts.auth_aligned", "facts.org_domain", F.unix_timestamp("sent_at").alias("sent")).withColumn("references", F.array_join("references", " ")).drop("facts", "sent_at")
