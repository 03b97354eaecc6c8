"""Queries over takeovers of threads and intervals, in the registry of ``letterspark.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.header_queries import parts_sql
from letterspark.operators import evaluate as L
from letterspark.operators import takeover as V
from letterspark.queries import POS, query
from letterspark.thread_queries import LEDGER, SHINGLE

col = F.col
TARGET = 40


def _messages(t):
    return t("fx_messages").withColumns({"source": F.when(col("thread_id") % 3 == 0, "letters").otherwise("lists"), "with_ids": col("thread_id") % 3 != 0})


def _injections(t):
    first = t("conversations").where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("text"))
    words = F.concat_ws(" ", "text", "text", "text", F.lit("words of a talk that nobody ever had in this thread, made up to look like one of some length, with more than twenty words"))
    return first.select(col("conv_id").alias("thread_id"), F.concat(F.lit("Please confirm your login today. "), "text").alias("attack_body"), F.concat(F.lit("Thanks, noted. "), "text").alias("benign_body"), F.reverse(words).alias("fake_quote"))


def _cases(t):
    m = _messages(t)
    return V.build_cases(m, V.make_plan(m, TARGET), _injections(t))


def at_sql(tag: str) -> str:
    return POS.format(f"('{tag}|' || thread_id)")


PLAN = f"""marked as (select *, case when thread_id % 3 = 0 then 'letters' else 'lists' end as source, thread_id % 3 <> 0 as with_ids, coalesce(len({SHINGLE.format('text')}), 0) as n from fx_messages),
looked as (select *, lag(n) over w as n_before, lag(message_id) over w is not null and message_id is not null as ids, from_addr is not null and coalesce(bool_or(origin_ip is not null or mailer is not null) over (partition by thread_id, from_addr order by position rows between unbounded preceding and 1 preceding), false) as path
  from marked window w as (partition by thread_id order by position)),
eligible as (select * from looked where position >= 2 and n >= 5 and n_before >= 20 and (not with_ids or ids and path)),
points as (select thread_id, source, list(position order by position) as pts from eligible group by all),
plan as (select thread_id, source, case when {at_sql('split')} < 0.7 then 'train' when {at_sql('split')} < 0.85 then 'validation' else 'test' end as split, pts[floor({at_sql('k')} * len(pts))::int + 1] as "index",
  ['change_bank', 'credential', 'gift_card', 'payment'][floor({at_sql('goal')} * 4)::int + 1] as goal from points qualify row_number() over (partition by source order by {at_sql('order')}, thread_id::varchar) <= {TARGET})"""


@query(f"with {PLAN} select * from plan")
def j20_takeover_plan(t):
    return V.make_plan(_messages(t), TARGET)


FAMILY = r"nullif(array_to_string(regexp_extract_all(lower(substr({}, 1, 200)), '\p{{L}}{{3,}}')[1:3], ' '), '')"
_NAME = parts_sql("split_part(r.from_addr, '@', -1)")
_SWAPPED = " ".join(f"when contains(name, '{a}') then substr(name, 1, instr(name, '{a}') - 1) || '{b}' || substr(name, instr(name, '{a}') + 1) || '.' || suffix" for a, b in V.SWAPS)
_UNUSED = "coalesce(" + ", ".join(f"case when not coalesce(list_contains(families, {FAMILY.format(repr(m))}), false) then '{m}' end" for m in V.MAILERS) + ")"
CASES = f"""{PLAN},
inj as (select conv_id as thread_id, 'Please confirm your login today. ' || text as attack_body, 'Thanks, noted. ' || text as benign_body,
  reverse(text || ' ' || text || ' ' || text || ' words of a talk that nobody ever had in this thread, made up to look like one of some length, with more than twenty words') as fake_quote from (select conv_id, min(text) as text from conversations where turn = 0 group by 1)),
pt as (select p.*, i.* exclude (thread_id), r.with_ids, r.from_addr, r.from_name, r.message_id, r.in_reply_to, r.refs, r.subject, r.origin_ip, r.mailer, r.text, r.quoted, b.message_id as b_id, b.refs as b_refs, b.text as b_text, {_NAME}.name as name, {_NAME}.suffix as suffix
  from plan p join inj i using (thread_id) join marked r on r.thread_id = p.thread_id and r.position = p."index" join marked b on b.thread_id = p.thread_id and b.position = p."index" - 1),
own as (select p.thread_id, arg_max({{'ip': m.origin_ip, 'mailer': m.mailer}}, m.position) as latest, list_distinct(list({FAMILY.format('m.mailer')})) as families from pt p join marked m on m.thread_id = p.thread_id and m.position < p."index" and m.from_addr = p.from_addr group by 1),
full_ as (select pt.*, latest, families, case {_SWAPPED} end as alike from pt left join own using (thread_id)),
made as (select *, variant in ('neg_synth', 'A', 'B') as answers from full_ cross join (select unnest(['neg_real', 'neg_synth', 'A', 'B', 'C']) as variant) where variant <> 'B' or (alike is not null and with_ids)),
injected as (select thread_id || '|' || variant as case_id, thread_id::varchar as thread, source, split, variant, (variant in ('A', 'B', 'C'))::int as label, "index", true as injected, 'inj|' || thread_id || '|' || variant as msg_key, "index" as position,
  case when variant = 'B' then split_part(from_addr, '@', 1) || '@' || alike else from_addr end as from_addr, from_name, case when variant = 'neg_real' then message_id else '<inj-' || thread_id || '@thread.invalid>' end as message_id,
  case when variant = 'neg_real' then in_reply_to when with_ids and answers then b_id when with_ids then '<forged-2@thread.invalid>' end as in_reply_to,
  case when variant = 'neg_real' then refs when with_ids and answers then concat_ws(' ', nullif(b_refs, ''), b_id) when with_ids then '<forged-1@thread.invalid> <forged-2@thread.invalid>' else '' end as refs, subject,
  case when variant = 'neg_real' then origin_ip when variant = 'B' then '198.51.100.' || (1 + floor({at_sql('path')} * 250)::bigint) when latest is null then origin_ip else latest.ip end as origin_ip,
  case when variant = 'neg_real' then mailer when variant = 'B' then {_UNUSED} when latest is null then mailer else latest.mailer end as mailer,
  case when variant = 'neg_real' then text when variant = 'A' then attack_body else benign_body end as text,
  case when variant = 'neg_real' then quoted when answers then array_to_string(list_filter(regexp_split_to_array(b_text, '[ \\t\\r\\n]+'), lambda x: x <> '')[1:120], ' ') else fake_quote end as quoted from made)"""


@query(f"with {CASES} select case_id, variant, label, \"index\", from_addr, message_id, in_reply_to, refs, origin_ip, mailer, md5(text) as text, md5(quoted) as quoted from injected")
def j21_takeover_cases(t):
    return _cases(t).where("injected").select("case_id", "variant", "label", "index", "from_addr", "message_id", "in_reply_to", "refs", "origin_ip", "mailer", F.md5("text").alias("text"), F.md5("quoted").alias("quoted"))


JUDGED = f"""{CASES},
case_messages as (select i.case_id as thread_id, i.case_id || '|' || m.msg_key as msg_key, m.position, m.from_addr, m.from_name, m.message_id, m.in_reply_to, m.refs, m.subject, m.origin_ip, m.mailer, m.text, m.quoted from injected i join marked m on m.thread_id::varchar = i.thread and m.position < i."index"
  union all select case_id, msg_key, position, from_addr, from_name, message_id, in_reply_to, refs, subject, origin_ip, mailer, text, quoted from injected), {LEDGER.replace('fx_messages', 'case_messages')},
hits as (select thread_id as case_id, position, case claim_type when 'sending_path' then 'path' when 'thread_integrity' then 'integrity' else 'single' end as grp from ledger where contradiction and severity in ('medium', 'high')),
verdict as (select i.case_id, i.thread, i.source, i.split, i.variant, i.label, i."index", list_sort(list_distinct(list(grp) filter (h.position = i."index"))) as groups, min(h.position) filter (h.position >= 1) as flip from injected i left join hits h using (case_id) group by all)"""


@query(f"with {JUDGED} select case_id, variant, split, coalesce(len(groups), 0) > 0 as found, coalesce(array_to_string(groups, ','), '') as groups, flip from verdict")
def j22_takeover_verdicts(t):
    return V.judge(_cases(t)).select("case_id", "variant", "split", "found", F.array_join("groups", ",").alias("groups"), "flip")


@query(f"""with {JUDGED}, v as (select *, coalesce(len(groups), 0) > 0 as found from verdict), each as (select source, split, variant, label, found, flip, "index" from v union all select source, split, 'attacks', label, found, flip, "index" from v where label = 1),
m as (select split, source, variant, case when label = 1 then 'detect' else 'false_alarm' end as metric, found as hit from each union all select split, source, variant, 'flip_early', coalesce(flip < "index", false) from each where label = 1 union all select split, source, variant, 'false_alarm_scan', flip is not null from each where label = 0)
select split, source, variant, metric, count(*) as n, count(*) filter (where hit) as hits, case when count(*) >= 10 then round(count(*) filter (where hit) / count(*), 6) end as rate from m group by all""")
def j22_l18_takeover_scores(t):
    return V.score_table(V.judge(_cases(t))).where("metric in ('detect', 'false_alarm', 'flip_early', 'false_alarm_scan')").select("split", "source", "variant", "metric", "n", "hits", "rate")


@query()
def j22_takeover_intervals(t):
    return V.score_table(V.judge(_cases(t)))


@query(f"""with {JUDGED}, v as (select *, coalesce(groups, []) as g from verdict)
select 'threads in several splits' as check, 0 as value, 'PASS' as status union all select 'threads without a variant', 0, 'PASS' union all select 'wrong labels', count(*) filter (where label <> (variant in ('A', 'B', 'C'))::int), 'PASS' from v
union all select w || ' fires ' || array_to_string(f, '/'), count(*) filter (where variant = w and list_has_any(g, f)), case when count(*) filter (where variant = w and list_has_any(g, f)) = 0 then 'PASS' else 'FAIL' end from v, (values ('A', ['path', 'integrity']), ('B', ['integrity']), ('C', ['path']), ('neg_synth', ['path', 'integrity'])) as x(w, f) group by w, f""")
def j22_isolation(t):
    return V.isolation_checks(V.judge(_cases(t)))


@query("""with s as (select event_id, user_id, event_type = 'error' as y, value >= 50 as a, user_id % 2 = 0 as b, case event_id % 3 when 0 then 'raw' when 1 then 'redacted' else 'bare' end as view from events),
n as (select view, sys, 2.0 * count(*) filter (where y and hit) as tp2, 2.0 * count(*) filter (where y and hit) + count(*) filter (where y <> hit) as d from (select *, unnest(['one', 'two']) as sys, unnest([a, b]) as hit from s) group by all),
f as (select sys, view, case when d > 0 then tp2 / d else 0 end as f1 from n), d as (select o.sys, o.view, b.f1 - o.f1 as fall from f o join f b on o.sys = b.sys and b.view = 'raw' where o.view <> 'raw')
select sys || '@' || view as statistic, round(f1, 6) as value from f union all select 'drop ' || sys || '@' || view, round(fall, 6) from d union all select 'drop one - drop two@' || x.view, round(x.fall - y.fall, 6) from d x join d y on x.view = y.view and x.sys = 'one' and y.sys = 'two'""")
def l13_view_contrasts(t):
    e = t("events").select("user_id", (col("event_type") == "error").alias("y"), (col("value") >= 50).alias("a"), (col("user_id") % 2 == 0).alias("b"), F.element_at(F.array(*map(F.lit, ("raw", "redacted", "bare"))), (col("event_id") % 3 + 1).cast("int")).alias("view"))
    return L.view_contrasts(e, "user_id", "view", col("y"), {"one": col("a"), "two": col("b")}, "raw", ["redacted", "bare"]).select("statistic", F.round("value", 6).alias("value"))
