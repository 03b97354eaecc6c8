"""Queries over bank details, in the registry of ``letterspark.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators import bank as N
from letterspark.queries import query

col = F.col


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


KIND = "case label " + " ".join(f"when '{k}' then '{v}'" for k, v in N.LABELS.items()) + " end"
LENGTH = "case v[1:2] " + " ".join(f"when '{k}' then {n}" for k, n in N.COUNTRY_LENGTHS.items()) + " else length(v) end"
EDGES = N.EDGES.replace("'", "''")
#: Bank details by joins of numbered words: ``details_ (msg_id, thread_id, kind, value, masked, no)``.
DETAILS = f"""bank_words as (select msg_id, thread_id, list_transform(list_filter(string_split(substr(coalesce(body, ''), 1, 5000), ' '), lambda w: w <> ''), lambda w: trim(w, '{EDGES}')) as ws from fx_bodies),
bank_at as (select msg_id, thread_id, ws, unnest(range(1, len(ws) + 1)) as i from bank_words),
bank_heads as (select msg_id, thread_id, i, ws[i] as head, ws[i + 1:i + 8] as behind from bank_at where regexp_full_match(ws[i], '[A-Za-z]{{2}}[0-9]{{2}}[A-Za-z0-9]*')),
bank_grown as (select msg_id, thread_id, i, n, upper(head || array_to_string(behind[1:n], '')) as v from bank_heads, range(0, 9) as r(n)
  where n = 0 or (length(head) = 4 and n <= len(behind) and len(list_filter(behind[1:n], lambda g: not regexp_full_match(g, '[A-Za-z0-9]{{1,4}}'))) = 0)),
bank_valid as (select * from bank_grown where regexp_full_match(v, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') and length(v) = {LENGTH}
  and list_reduce(list_prepend(0, list_transform(string_split(v[5:] || v[1:4], ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)), lambda a, d: (a * (case when d > 9 then 100 else 10 end) + d) % 97) = 1),
bank_labels as (select msg_id, thread_id, i, lower(ws[i]) as label, list_filter(ws[i + 1:i + 4], lambda w: lower(w) not in ({_quoted(N.FILLERS)}))[1] as part from bank_at where lower(ws[i]) in ({_quoted(N.LABELS)})),
bank_kinds as (select *, {KIND} as kind, replace(part, '-', '') as bare from bank_labels),
bank_all as (select msg_id, thread_id, 0 as place, i, 'iban' as kind, max_by(v, n) as value from bank_valid group by msg_id, thread_id, i
  union all select msg_id, thread_id, 1, i, kind, case kind when 'swift' then upper(part) else bare end from bank_kinds
  where case kind when 'swift' then regexp_full_match(part, '[A-Za-z]{{6}}([A-Za-z0-9]{{2}}|[A-Za-z0-9]{{5}})') when 'account' then regexp_full_match(bare, '[0-9]{{6,17}}') else regexp_full_match(bare, '[0-9]{{6}}|[0-9]{{9}}') end),
bank_ranked as (select msg_id, thread_id, kind, value, row_number() over (partition by msg_id order by place_) as no
  from (select msg_id, thread_id, kind, value, min(place * 100000 + i) as place_ from bank_all group by msg_id, thread_id, kind, value)),
details_ as (select *, case kind when 'iban' then value[1:2] || '**' || right(value, 4) when 'swift' then value[1:4] || '****' else '****' || right(value, 4) end as masked from bank_ranked where no <= 10)"""


@query(f"with {DETAILS} select msg_id, no, kind, value, masked from details_")
def i11_bank_details(t):
    found = t("fx_bodies").select("msg_id", F.posexplode(N.bank_details(col("body"))).alias("no", "d"))
    return found.select("msg_id", (col("no") + 1).alias("no"), "d.kind", "d.value", "d.masked")


@query(f"with {DETAILS} select thread_id, kind, value, min(msg_id) as first, count(distinct msg_id) as n from details_ group by all")
def i11_j9_first_seen(t):
    rows = t("fx_bodies").select("thread_id", "msg_id", N.bank_details(col("body")).alias("details"))
    return N.first_seen(rows, "thread_id", "msg_id", "details")
