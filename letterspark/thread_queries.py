"""Queries over conversations, in the registry of ``letterspark.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.header_queries import parts_sql, registered_sql, skeleton_sql
from letterspark.operators import threads as J
from letterspark.queries import MOD100, query
from letterspark.streaming import threads as S

col = F.col
LINE = r"lower(substr(trim(regexp_replace(subject, '[ \t\r\n]+', ' ', 'g')), 1, 300))"
PREFIXES = r"(?:(?:re|fw|fwd|aw|sv|antw)[ ]*(?:\[[0-9]{1,5}\][ ]*)?:[ ]*)"
NSUB = f"regexp_replace({LINE}, '^{PREFIXES}{{1,20}}', '')"
PREFIXED = f"regexp_matches({LINE}, '^{PREFIXES}')"
REPLY = "starts_with(lower(trim(subject)), 're:')"
FORWARD = "regexp_matches(lower(trim(subject)), '^fwd?:')"


@query(f"select msg_key, {NSUB} as subject, {PREFIXED} as has_prefix, {REPLY} as is_reply, {FORWARD} as is_forward from fx_messages")
def j1_subjects(t):
    s = col("subject")
    return t("fx_messages").select("msg_key", J.normalise_subject(s).alias("subject"), J.has_prefix(s).alias("has_prefix"), J.is_reply(s).alias("is_reply"), J.is_forward(s).alias("is_forward"))


@query("""with recursive edge as (select msg_key as a, message_id as b from fx_messages union select msg_key, in_reply_to from fx_messages where in_reply_to is not null union select msg_key, unnest(regexp_extract_all(refs, '<[^<> ]+>')) from fx_messages),
near as (select distinct x.a, y.a as other from edge x join edge y on x.b = y.b where x.b not in (select b from edge group by b having count(*) > 50)),
hubs as (select b, min(a) as least from edge group by b having count(*) > 50), star as (select e.a, h.least as other from edge e join hubs h on e.b = h.b union select h.least, e.a from edge e join hubs h on e.b = h.b),
link as (select * from near union select * from star), walk as (select a, a as r from link union select w.a, l.other from walk w join link l on w.r = l.a)
select a as msg_key, min(r) as component from walk group by 1""")
def j2_reply_components(t):
    return J.reply_components(t("fx_messages"), references="refs")


@query("""with recursive m as (select event_id, user_id, date_trunc('hour', ts) as run, user_id % 7 as p1, (user_id + event_id) % 11 + 100 as p2 from events where ts is not null),
sized as (select m.* from m join (select run from m group by run having count(*) between 2 and 30) using (run)), person as (select event_id, run, p1 as p from sized union select event_id, run, p2 from sized where event_id % 3 = 0),
link as (select distinct x.event_id as a, y.event_id as b from person x join person y on x.run = y.run and x.p = y.p), walk as (select a, a as r from link union select w.a, l.b from walk w join link l on w.r = l.a)
select a as event_id, min(lpad(r::varchar, 12, '0')) as component from walk group by 1""")
def j4_participant_components(t):
    e = t("events").where("ts is not null").select(F.lpad(col("event_id").cast("string"), 12, "0").alias("msg_key"), F.date_trunc("hour", "ts").cast("string").alias("run"), "event_id", "user_id")
    people = F.array_compact(F.array(F.concat(F.lit("a"), col("user_id") % 7), F.when(col("event_id") % 3 == 0, F.concat(F.lit("b"), (col("user_id") + col("event_id")) % 11))))
    return J.participant_components(e.withColumn("people", people), ["run"], least=2, most=30).select(col("msg_key").cast("long").alias("event_id"), "component")


@query(f"""with n as (select thread_id, count(*) as n, count(*) filter (where sent is null) as undated, count(distinct case when sent is not null then from_addr end) as senders, count(*) filter (where sent is not null and {PREFIXED}) as replies from fx_messages group by 1)
select *, case when n < 2 then 'single' when n - undated < 3 then 'short' when n - undated > 6 then 'long' when senders < 2 then 'one sender' when replies < 2 then 'few replies' else 'kept' end as reason from n""")
def j5_thread_filters(t):
    return J.thread_filters(t("fx_messages"), most=6)


ORDERED = f"""placed as (select msg_key, thread_id as conv, row_number() over w - 1 as position, substr(sha256('t|' || first_value(msg_key) over w), 1, 16) as thread_id from fx_messages where sent is not null window w as (partition by thread_id order by sent, msg_key)),
ordered as (select *, {MOD100.format('thread_id', 100)} as bucket from placed)"""
SPLIT = "case when bucket < 70 then 'train' when bucket < 85 then 'validation' else 'test' end"


@query(f"with {ORDERED} select msg_key, position, thread_id, {SPLIT} as split from ordered")
def j6_ordered(t):
    return J.ordered(t("fx_messages"), "thread_id", "sent").select("msg_key", "position", "thread_id", "split")


@query(f"with {ORDERED}, n as (select conv, any_value({SPLIT}) as split, count(*) as n from ordered group by 1) select split, least(n, 10) as size, count(*) as threads from n group by all")
def j7_size_buckets(t):
    placed = J.ordered(t("fx_messages").withColumn("conv", col("thread_id")), "conv", "sent")
    return J.size_buckets(placed, "thread_id", F.col("split"))


SAME = "regexp_replace(lower({}from_name), '[^\\p{{L}}]+', '', 'g')"
RANK = """case when b.from_addr = a.from_addr then 9 when here = there then 0 when here_reg = there_reg then 0 when here_name = there_name then 2
  when skel_h = skel_t then 3 when least(length(here_name), length(there_name)) >= 6 and here_reg in ('examp1e.com', 'example.com') and there_reg in ('examp1e.com', 'example.com') then 3 else 1 end"""
IDENTITY = f"""who as (select msg_key, thread_id, position, from_addr, regexp_replace(lower(from_name), '[^\\p{{L}}]+', '', 'g') as n, split_part(from_addr, '@', 1) as l, split_part(from_addr, '@', 2) as d from fx_messages),
met as (select a.msg_key, a.from_addr as mine, b.from_addr as theirs, a.d as here, b.d as there from who a join who b on a.thread_id = b.thread_id and b.position < a.position and b.position >= a.position - 49 and b.from_addr is not null and a.from_addr is not null
  and (a.from_addr = b.from_addr or (length(a.n) >= 5 and length(b.n) >= 5 and a.n = b.n) or (length(a.l) >= 5 and length(b.l) >= 5 and a.l = b.l))),
ranked as (select msg_key, case when mine = theirs then 9 when here = there then 0 when {parts_sql('here')}.name = {parts_sql('there')}.name then 2 when {skeleton_sql(parts_sql('here') + '.name')} = {skeleton_sql(parts_sql('there') + '.name')} then 3 else 1 end as r, case when mine <> theirs then there end as d from met),
strong as (select msg_key, max(r) as r, arg_max(d, r * 1000 + coalesce(ascii(substr(d, 8, 1)), 0)) as d from ranked group by 1),
identity_ as (select w.msg_key, least(49, w.position) as n_earlier, case when w.from_addr is null then 'no_from' when r = 9 then 'same_address' when r = 0 then 'same_domain' when r = 1 then 'other_domain' when r = 2 then 'suffix' when r = 3 then 'lookalike' else 'new_sender' end as status from who w left join strong s on w.msg_key = s.msg_key)"""


@query(f"with {IDENTITY} select * from identity_")
def j11_sender_identity(t):
    return J.sender_identity(t("fx_messages")).drop("earlier_domain")


PATH = r"""nets as (select *, case when len(string_split(origin_ip, '.')) = 4 then array_to_string(string_split(origin_ip, '.')[1:3], '.') when contains(origin_ip, ':') then array_to_string(string_split(origin_ip, ':')[1:4], ':') else nullif(origin_ip, '') end as network,
  nullif(array_to_string(regexp_extract_all(lower(substr(mailer, 1, 200)), '\p{L}{3,}')[1:3], ' '), '') as family from fx_messages),
paths as (select msg_key, network, family, case when from_addr is not null and network is not null and count(network) over (partition by thread_id, from_addr order by position rows between unbounded preceding and 1 preceding) > 0 then row_number() over (partition by thread_id, from_addr, network order by position) = 1 end as new_network,
  case when from_addr is not null and family is not null and count(family) over (partition by thread_id, from_addr order by position rows between unbounded preceding and 1 preceding) > 0 then row_number() over (partition by thread_id, from_addr, family order by position) = 1 end as new_mailer from nets)"""


@query(f"with {PATH} select * from paths")
def j12_path_drift(t):
    return J.path_drift(t("fx_messages"))


IDS = """named as (select distinct msg_key, thread_id, position, in_reply_to, unnest(list_filter(list_append(regexp_extract_all(refs, '<[^<> ]+>'), in_reply_to), lambda x: x is not null)) as id from fx_messages),
hit as (select n.*, coalesce(m.position < n.position, false) as known from named n left join fx_messages m on n.thread_id = m.thread_id and n.id = m.message_id),
counted as (select msg_key, count(*) as total, count(*) filter (where known) as known, max(case when id = in_reply_to then known end) as parent_known from hit group by 1),
ids as (select m.msg_key, coalesce(total, 0) as total, coalesce(known, 0) as known, parent_known from fx_messages m left join counted c on m.msg_key = c.msg_key)"""


@query(f"with {IDS} select * from ids")
def j13_reference_integrity(t):
    return J.reference_integrity(t("fx_messages"))


SHINGLE = r"list_filter(string_split(lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
QUOTES = f"""w as (select thread_id, position, msg_key, {FORWARD} as forward, {SHINGLE.format('text')} as tw, {SHINGLE.format('quoted')} as qw from fx_messages),
said as (select thread_id, s, min(position) as first from (select thread_id, position, array_to_string(tw[i : i + 4], ' ') as s from (select *, unnest(range(1, len(tw) - 3)) as i from w)) group by 1, 2),
q as (select distinct msg_key, thread_id, position, array_to_string(qw[i : i + 4], ' ') as s from (select *, unnest(range(1, len(qw) - 3)) as i from w where len(qw) >= 20 and not forward)),
quotes as (select msg_key, count(*) as shingles, count(*) filter (where first < position) as known, round(count(*) filter (where first < position) / count(*), 6) as share from q left join said using (thread_id, s) group by 1)"""


@query(f"with {QUOTES} select * from quotes")
def j14_quotation_integrity(t):
    return J.quotation_integrity(t("fx_messages"))


@query(f"""with {IDENTITY}, c as (select msg_key, 'c1' as claim_id from fx_messages where position % 2 = 0 or thread_id % 3 = 0)
select c.msg_key, claim_id, 'prior_relationship' as claim_type, rule, case rule when 'tv_prior_ok' then 'none' when 'tv_prior_other_address' then 'low' when 'tv_prior_stranger' then 'low' else 'not_checkable' end as severity from c join
  (select *, case when n_earlier = 0 then 'tv_prior_no_thread' when status = 'no_from' then 'tv_prior_no_from' when status in ('same_address', 'same_domain') then 'tv_prior_ok' when status in ('lookalike', 'suffix', 'other_domain') then 'tv_prior_other_address' when n_earlier < 2 then 'tv_prior_few' else 'tv_prior_stranger' end as rule from identity_) i on c.msg_key = i.msg_key""")
def j15_prior_rows(t):
    m = t("fx_messages")
    claims = m.where((col("position") % 2 == 0) | (col("thread_id") % 3 == 0)).select("msg_key", F.lit("c1").alias("claim_id"))
    return J.prior_rows(claims, J.sender_identity(m))


SEVERITIES = {
    "tv_single_no_reply_ids": "low", "tv_who_lookalike": "high", "tv_who_suffix": "medium", "tv_who_other_domain": "low", "tv_path_origin_mailer": "medium", "tv_path_origin": "low", "tv_path_mailer": "low", "tv_int_ids_unknown": "medium",
    "tv_int_parent_missing": "low", "tv_quote_mismatch": "high", "tv_single_ids_present": "none", "tv_who_same_address": "none", "tv_who_same_domain": "none", "tv_path_same": "none", "tv_int_ids_ok": "none", "tv_quote_ok": "none",
}
LEDGER = f"""{IDENTITY}, {PATH}, {IDS}, {QUOTES},
joined as (select m.msg_key, m.thread_id, m.position, {REPLY} as reply, {FORWARD} as forward, m.in_reply_to is not null or m.refs <> '' as ids_named, coalesce(len({SHINGLE.format('m.quoted')}), 0) as words, i.status, i.n_earlier, p.new_network, p.new_mailer, d.total, d.known, d.parent_known, q.share
  from fx_messages m join identity_ i on m.msg_key = i.msg_key join paths p on m.msg_key = p.msg_key join ids d on m.msg_key = d.msg_key left join quotes q on m.msg_key = q.msg_key),
signals as (select msg_key, thread_id, position, 'single_email' as claim_type, case when not reply then 'tv_single_not_reply' when words < 20 then 'tv_single_no_quote' when ids_named then 'tv_single_ids_present' else 'tv_single_no_reply_ids' end as rule from joined where n_earlier = 0
  union all select msg_key, thread_id, position, 'sending_path', 'tv_who_' || status from joined where n_earlier > 0
  union all select msg_key, thread_id, position, 'sending_path', case when new_network is null and new_mailer is null then 'tv_path_no_data' when new_network and new_mailer then 'tv_path_origin_mailer' when new_network then 'tv_path_origin' when new_mailer then 'tv_path_mailer' else 'tv_path_same' end from joined where n_earlier > 0 and status = 'same_address'
  union all select msg_key, thread_id, position, 'thread_integrity', case when total = 0 then 'tv_int_no_ids' when known = 0 then 'tv_int_ids_unknown' when not parent_known then 'tv_int_parent_missing' else 'tv_int_ids_ok' end from joined where n_earlier > 0
  union all select msg_key, thread_id, position, 'thread_integrity', case when forward then 'tv_quote_forward' when share is null then 'tv_quote_none' when share < 0.3 then 'tv_quote_mismatch' else 'tv_quote_ok' end from joined where n_earlier > 0),
judged as (select *, case rule {" ".join(f"when '{k}' then '{v}'" for k, v in SEVERITIES.items())} else 'not_checkable' end as severity from signals),
ledger as (select msg_key, thread_id, position, claim_type, rule, case when severity in ('low', 'medium', 'high') then true when severity = 'none' then false end as contradiction, severity from judged)"""


@query(f"with {LEDGER} select * from ledger")
def j16_j17_signal_ledger(t):
    return J.signal_ledger(t("fx_messages"))


@query(f"""with {LEDGER} select rule, case when grouping(part) = 1 then 'all' else part::varchar end as part, count(*) filter (where contradiction) as contradictions, count(*) filter (where not contradiction) as consistent, count(*) filter (where contradiction is null) as not_checkable
from (select *, thread_id % 4 as part from ledger) group by grouping sets ((rule), (rule, part))""")
def j19_signal_rates(t):
    return J.signal_rates(J.signal_ledger(t("fx_messages")).withColumn("part", col("thread_id") % 4), "part")


@query("""with g as (select event_id, event_type, user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over w > 3600000000 then 1 else 0 end as new_ from events window w as (partition by event_type, user_id order by ts, event_id))
select event_id, sum(new_) over (partition by event_type, user_id order by ts, event_id rows unbounded preceding)::bigint + 1 as run from g""")
def j3_gap_runs(t):
    return J.gap_runs(t("events").select("event_id", "event_type", "user_id", "ts"), ["event_type", "user_id"], "ts", "event_id", 3600).select("event_id", "run")


@query("""with e as (select event_id, user_id, value, max(value) over w as m, avg(value) over w as a, count(value) over w as c from events window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding))
select event_id, coalesce(value >= 100 and coalesce(m, -1e9) < 100 and value - a >= 0.4 and c >= 2, false) as onset from e""")
def j8_onset(t):
    return J.onset(t("events").select("event_id", "user_id", "value"), "user_id", "event_id", "value", 100.0).select("event_id", "onset")


@query("""select event_id, case when min(event_id) over (partition by user_id, event_type) = event_id then 'first' when min(event_id) over (partition by user_id, event_type, floor(value)) < event_id then 'seen' else 'changed' end as drift from (select *, floor(value) as v from events)""")
def j9_drift(t):
    e = t("events").select("event_id", "user_id", "event_type", F.floor("value").alias("v"))
    return J.drift(e, "user_id", "event_id", "event_type", "v").select("event_id", "drift")


@query("""select msg_id, min(case when contradiction and position >= 2 and severity in ('medium', 'high') then position end) as flip, max(case when contradiction then case severity when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end else 0 end) as worst
from (select *, substr(claim_id, 2)::int as position from fx_ledger) group by 1""")
def j18_flip_points(t):
    return J.flip_points(t("fx_ledger").withColumn("position", F.expr("int(substr(claim_id, 2))")))




@query(f"""with {LEDGER}, worst as (select msg_key, thread_id, position, string_agg(claim_type || ':' || rule || ':' || severity, ',' order by claim_type, rule) as verdicts,
  case max(case severity when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end) when 3 then 'high' when 2 then 'medium' when 1 then 'low' end as worst from ledger group by all)
select msg_key, least(49, position) as n_earlier, verdicts, worst, first_value(case when worst in ('medium', 'high') and position > 0 then msg_key end ignore nulls) over (partition by thread_id order by position) as flip_key from worst""")
def m2_thread_state(t):
    m = t("fx_messages").withColumn("sent", F.timestamp_seconds(col("position") * 60))
    S.use_rocksdb(m.sparkSession)
    one = F.transform("verdicts", lambda v: F.concat_ws(":", v["claim_type"], v["rule"], v["severity"]))
    return S.score_threads(m).select("msg_key", "n_earlier", F.array_join(F.array_sort(one), ",").alias("verdicts"), "worst", "flip_key")
