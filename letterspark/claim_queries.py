"""Queries over claims in messages, in the registry of ``letterspark.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators import claim_phrases as W
from letterspark.operators import claims as H
from letterspark.plans.shared import spread
from letterspark.queries import query

col = F.col


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


TEXT = """concat(text, case doc_id % 8 when 0 then ' I am the new CEO and as we discussed, please verify all your account details and sign in.' when 1 then ' Transfer the sum of 9000 euros today, pay 10 dollars, to our new bank account number.'
  when 2 then concat(' Buy gift cards. Buy a gift card. Gift cards! gift cards; reply to me only', chr(10), 'Tel: +49 30 1234567, mail [EMAIL], fax 2024-01-02') when 3 then ' Write on behalf of PayPal security team; Copyright 2024 PayPal and Acme' when 4 then concat(' sign in', chr(10), 'Best regards,', chr(10), 'Ann Lee') when 5 then ' send us the passport and payslips for our finance team' else '' end)"""
CASES = [(p[1], f"({H.compile_phrase(p[2])})", p[3], p[0]) for p in H.SHORT_PATTERNS]
FOUND = " union all ".join(f"select doc_id, text, '{k}' as type, regexp_extract_all(text, {lit(p)}, 1) as m, regexp_split_to_array(text, {lit(p)}) as s, {c} as confidence, '{i}' as pattern from mail" for k, p, c, i in CASES)
PLACED = f"""mail as (select doc_id, source, {TEXT} as text from documents), found as ({FOUND}), some_ as (select * from found where len(m) > 0),
one_ as (select doc_id, text, type, confidence, pattern, unnest(range(1, len(m) + 1)) as k, m, s from some_),
placed as (select doc_id, text, type, confidence, pattern, (list_sum(list_transform(s[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0))::int as start, m[k] as claim from one_)"""


def _mail(t):
    return spread(t("documents").select("doc_id", "source", "text")).select("doc_id", "source", F.expr(TEXT).alias("text"))


@query(f"with {PLACED} select doc_id, type, confidence, pattern, start, start + length(claim) as \"end\", claim from placed")
def h1_h2_phrase_candidates(t):
    rows = _mail(t).select("doc_id", "text", F.explode(H.phrase_candidates(col("text"))).alias("c"))
    return rows.select("doc_id", "c.type", "c.confidence", "c.pattern", "c.start", "c.end", F.substr("text", col("c.start") + 1, col("c.end") - col("c.start")).alias("claim"))


SELECTED = f"""{PLACED}, ranked as (select *, row_number() over (partition by doc_id, type order by -length(claim), -confidence, start) as rn from placed where length(claim) <= 300),
kept as (select * from ranked r where not exists (select 1 from ranked o where o.doc_id = r.doc_id and o.type = r.type and o.rn < r.rn and o.start < r.start + length(r.claim) and r.start < o.start + length(o.claim))),
third as (select *, row_number() over (partition by doc_id, type order by rn) as k from kept), claims as (select *, row_number() over (partition by doc_id order by start, start + length(claim), type) as no from third where k <= 3)"""


@query(f"with {SELECTED} select doc_id, 'c' || no as claim_id, type, claim, start, confidence, pattern from claims where no <= 12")
def h6_selected_claims(t):
    rows = _mail(t).select("doc_id", "text", H.select(H.phrase_candidates(col("text"))).alias("c")).select("doc_id", "text", F.posexplode("c").alias("k", "c"))
    claim = F.substr("text", col("c.start") + 1, col("c.end") - col("c.start"))
    return rows.select("doc_id", F.concat(F.lit("c"), col("k") + 1).alias("claim_id"), "c.type", claim.alias("claim"), "c.start", "c.confidence", "c.pattern")


def _claims(t):
    brands = t("documents").sparkSession.createDataFrame([("PayPal",), ("Acme",)], "name string")
    return H.extract(_mail(t), patterns=H.SHORT_PATTERNS, organisations=brands)


@query()
def h3_h5_h7_claims(t):
    return _claims(t)


@query("select doc_id, 'c1' as claim_id, 'span' as problem from documents where doc_id % 5 = 0 and length(text) > 0 union all select doc_id, 'c2', 'text' from documents where doc_id % 7 = 0 and length(text) >= 3 union all select doc_id, 'c3', 'type' from documents where doc_id % 11 = 0")
def h8_claim_problems(t):
    d = t("documents")
    row = lambda m, no, kind, start, end, claim, least=0: d.where((col("doc_id") % m == 0) & (F.lit(least == 0) | (F.length("text") >= least))).select("doc_id", F.lit(no).alias("claim_id"), F.lit(kind).alias("type"), start.alias("start"), end.alias("end"), claim.alias("claim"), F.lit(0.9).alias("confidence"))
    bad = row(5, "c1", "authority", F.lit(0), F.length("text") + 1, col("text"), 1).unionByName(row(7, "c2", "authority", F.lit(0), F.lit(2), F.lit("\x01\x02"), 3)).unionByName(row(11, "c3", "rank", F.lit(0), F.lit(2), F.substring("text", 1, 2)))
    return H.problems(bad.unionByName(row(2, "c4", "authority", F.lit(0), F.lit(2), F.substring("text", 1, 2), 2)), d)


PRESENT = f"{SELECTED}, point as (select doc_id, type, max(confidence) as c from claims where no <= 12 group by all)"


def _selected(t):
    return H.extract(_mail(t), patterns=H.SHORT_PATTERNS).where("type <> 'signature_contact'")


@query(f"""with {PRESENT}, n as (select source, count(*) as n from mail group by 1 union all select 'all', count(*) from mail), h as (select type, source, count(*) filter (where c >= 0.9) as strong, count(*) as weak from point join mail using (doc_id) group by grouping sets ((type), (type, source)))
select x.type, n.source as scope, n.n, coalesce(strong, 0) as strong, coalesce(weak, 0) as weak from n cross join (select unnest([{', '.join(f"'{x}'" for x in H.TYPES)}]) as type) x left join h on h.type = x.type and coalesce(h.source, 'all') = n.source""")
def h9_hit_rates(t):
    return H.hit_rates(_mail(t), _selected(t), "source")


TRUTH = "truth as (select distinct doc_id, unnest(case when doc_id % 8 in (0, 4) then ['authority', 'credential_request'] when doc_id % 8 = 2 then ['gift_card'] when doc_id % 8 = 6 then ['gift_card', 'payment_request'] when doc_id % 16 = 1 then ['payment_request'] else [] end) as type from documents)"


def _truth(t):
    kinds = F.when((col("doc_id") % 8).isin(0, 4), F.array(F.lit("authority"), F.lit("credential_request"))).when(col("doc_id") % 8 == 2, F.array(F.lit("gift_card"))).when(col("doc_id") % 8 == 6, F.array(F.lit("gift_card"), F.lit("payment_request"))).when(col("doc_id") % 16 == 1, F.array(F.lit("payment_request")))
    return t("documents").select("doc_id", F.explode(kinds).alias("type"))


SCORES = f"""{PRESENT}, {TRUTH}, both_ as (select coalesce(t.type, p.type) as type, t.doc_id is not null as y, coalesce(c, 0) as c from truth t full join point p on t.doc_id = p.doc_id and t.type = p.type),
x as (select type, point, y, c >= least_ as p from both_ cross join (values ('strong', 0.9), ('weak', 0.6)) as v(point, least_)), counts as (select type, point, count(*) filter (where y and p) as tp, count(*) filter (where not y and p) as fp, count(*) filter (where y and not p) as fn from x group by all),
scores as (select *, case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0 end as precision, case when tp + fn > 0 then round(tp / (tp + fn), 6) else 0 end as recall, case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn), 6) else 0 end as f1 from counts)"""


@query(f"with {SCORES} select * from scores")
def h11_presence_scores(t):
    return H.presence_scores(_truth(t), _selected(t))


@query(f"with {SCORES}, p as (select type, max(f1) filter (where point = 'strong') as strong, max(f1) filter (where point = 'weak') as weak from scores group by 1) select *, case when weak > strong then 'weak' else 'strong' end as point from p")
def h12_operating_points(t):
    return H.operating_points(H.presence_scores(_truth(t), _selected(t)))


@query(f"with {PRESENT}, {TRUTH}, b as (select coalesce(t.type, p.type) as type, t.doc_id as a, p.doc_id as b from truth t full join point p on t.doc_id = p.doc_id and t.type = p.type) select type, count(*) filter (where a is not null and b is not null) as \"both\", count(a) as n_a, count(b) as n_b, round(2 * count(*) filter (where a is not null and b is not null) / (count(a) + count(b)), 6) as f1 from b group by 1")
def h13_annotator_f1(t):
    return H.annotator_f1(_truth(t), _selected(t))


@query()
def h10_span_scores(t):
    labels = _truth(t).where("type = 'gift_card'").select("doc_id", "type", F.lit("gift cards").alias("span"), F.lit("l1").alias("label_id"))
    return H.span_scores(labels, _selected(t))


def _values(rows) -> str:
    text = lambda v: "null" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


_ITEMS = [(p[0], i, x["kind"], x["n"], int(x["maybe"])) for p in W.PATTERNS for i, x in enumerate(W.parse(p[2]))]
_WORDS = [(p[0], i, w, k) for p in W.PATTERNS for i, x in enumerate(W.parse(p[2])) for k, some in ((0, x["words"]), (1, x["stems"])) for w in some]
FITS = """case t.kind when 'word' then exists (select 1 from lists l where l.pattern = t.pattern and l.i = t.i and (l.stem = 0 and l.word = lower(x.word) or l.stem = 1 and starts_with(lower(x.word), l.word)))
  when 'not' then not exists (select 1 from lists l where l.pattern = t.pattern and l.i = t.i and l.word = lower(x.word)) when 'exact' then exists (select 1 from lists l where l.pattern = t.pattern and l.i = t.i and l.word = x.word)
  when 'digits' then regexp_matches(x.word, '^[0-9]+$') else regexp_matches(x.word, '^\\p{Lu}') end"""

_SAYINGS = (
    "Hello, I am the acting CFO and I'm not the director.", "Dear user, verify your mailbox account now; click the link below to restore your access", "This message is from Global Widgets Ltd. On behalf of the Acme Bank, I write to you.", "Our IT team, it team and HR support staff",
    "Reply to my private email address [EMAIL] or text me on WhatsApp", "As we previously discussed, following our call, great seeing you", "Wire transfer: pay the invoice today. Payment is 3 days overdue!", "12 Old Mill Street, Springfield 98765; © 2024",
    "Update your bank details: new payroll account information", "buy me some gift-cards, five Apple cards", "Send your full passport and complete the form", "system administrator, network admin and the head of the finance department", "we've met you yesterday; don't write, you are receiving this because of it",
)
SAID = f"concat(text, ' ', case doc_id % {len(_SAYINGS)} {' '.join(f'when {i} then {lit(x)}' for i, x in enumerate(_SAYINGS))} end)"


@query(f"""with recursive mail as (select doc_id, {SAID} as text from documents), split as (select doc_id, regexp_extract_all(text, '{W.WORD.replace("'", "''")}') as w from mail where text is not null),
tokens as (select doc_id, unnest(range(len(w))) as pos, unnest(w) as word from split), items(pattern, i, kind, n, maybe) as (values {_values(_ITEMS)}), lists(pattern, i, word, stem) as (values {_values(_WORDS)}),
kinds as (select word, t.pattern, t.i from (select distinct word from tokens) x join items t on {FITS} and t.kind <> 'gap'),
way(doc_id, pattern, first, i, pos) as (select doc_id, k.pattern, pos, case when t.kind = 'name' then 0 else 1 end, pos + 1 from tokens x join kinds k on k.word = x.word and k.i = 0 join items t on t.pattern = k.pattern and t.i = 0
  union (select y.doc_id, y.pattern, y.first, y.i + s.step, y.pos + s.move from way y join items t on t.pattern = y.pattern and t.i = y.i
    join (select 0 as step, 1 as move, 'gap' as what union all select 1, 0, 'skip' union all select 1, 1, 'take') s on (s.what = 'take' and t.kind not in ('gap', 'name')) or (s.what = 'skip' and t.maybe = 1)
    left join tokens x on x.doc_id = y.doc_id and x.pos = y.pos left join kinds k on k.word = x.word and k.pattern = y.pattern and k.i = y.i
    where s.what = 'skip' or k.word is not null
  union all select y.doc_id, y.pattern, y.first, y.i + 1, y.pos + m from way y join items t on t.pattern = y.pattern and t.i = y.i and t.kind = 'gap' cross join range(7) as g(m) where m <= t.n
  union all select y.doc_id, y.pattern, y.first, y.i + 1, y.pos + m from way y join items t on t.pattern = y.pattern and t.i = y.i and t.kind = 'name' cross join range(1, 5) as g(m) where m <= t.n
    and not exists (select 1 from range(4) as o(j) left join tokens x on x.doc_id = y.doc_id and x.pos = y.pos + j left join kinds k on k.word = x.word and k.pattern = y.pattern and k.i = y.i where j < m and k.word is null))),
ends as (select pattern, max(i) + 1 as i from items group by 1), found as (select doc_id, pattern, first, max(pos) as last from way join ends using (pattern, i) group by all)
select doc_id, pattern, first, last, array_to_string(w[first + 1 : last], ' ') as claim from found join split using (doc_id)
where not exists (select 1 from (values (first), (last - 1)) as e(p) where w[p + 1] in ('EMAIL', 'URL', 'FILE', 'DOMAIN') and p > 0 and w[p] = '[' and w[p + 2] = ']')""")
def h1_pattern_matches(t):
    said = F.element_at(F.array(*map(F.lit, _SAYINGS)), (col("doc_id") % len(_SAYINGS)).cast("int") + 1)
    mail = t("documents").select("doc_id", F.concat("text", F.lit(" "), said).alias("text"))
    found = W.match_phrases(mail)
    claim = F.array_join(F.regexp_extract_all(F.substr("text", col("start") + 1, col("end") - col("start")), F.lit(f"({W.WORD})"), F.lit(1)), " ")
    return found.join(mail, "doc_id").select("doc_id", "pattern", "first", "last", claim.alias("claim"))
