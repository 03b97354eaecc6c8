"""Queries over header blocks and domains, in the registry of ``letterspark.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators import domains as D
from letterspark.operators import headers as E
from letterspark.queries import query

col = F.col


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# ---------------------------------------------------------------- domains
def labels_sql(d: str) -> str:
    return f"list_filter(string_split(lower(trim(trim({d}), '.')), '.'), lambda x: x <> '')"


def parts_sql(d: str) -> str:
    """The labels ``x``, their ends ``e``, the first end that a rule makes a suffix, and the tenant of a platform."""
    plain, stars, exceptions = map(quoted, D.by_kind(D.SUFFIXES))
    ends = "list_transform(range(1, len(v.x) + 1), lambda i: array_to_string(v.x[i:], '.'))"
    hit = f"list_contains([{plain}], v.e[i]) or (i < len(v.e) and list_contains([{stars}], v.e[i + 1]) and not list_contains([{exceptions}], v.e[i])) or (i > 1 and list_contains([{exceptions}], v.e[i - 1]))"
    first = f"list_filter(range(1, len(v.e) + 1), lambda i: {hit})[1]"
    whole = "v.x[v.i - 1] || '.' || v.e[v.i]"
    platform = f"({whole}) in ({quoted(D.PLATFORMS)}) and v.i > 2"
    found = f"case when v.i > 1 then {{'name': case when {platform} then v.x[v.i - 2] else v.x[v.i - 1] end, 'suffix': case when {platform} then {whole} else v.e[v.i] end}} end"
    steps = f"list_transform([{{'x': {labels_sql(d)}}}], lambda v: {{'x': v.x, 'e': {ends}}})"
    return f"list_transform(list_transform({steps}, lambda v: {{'x': v.x, 'e': v.e, 'i': {first}}}), lambda v: {found})[1]"


def registered_sql(d: str) -> str:
    return f"({parts_sql(d)}.name || '.' || {parts_sql(d)}.suffix)"


def free_sql(d: str) -> str:
    return f"coalesce({registered_sql(d)} in ({quoted(D.FREE_MAIL)}) or {parts_sql(d)}.suffix in ({quoted(D.PLATFORMS)}), false)"


def skeleton_sql(d: str) -> str:
    return f"translate(replace(replace(lower({d}), 'rn', 'm'), 'vv', 'w'), '{D.LOOKS}', '{D.LETTERS}')"


@query(f"select id, domain, {registered_sql('domain')} as registered, {free_sql('domain')} as free_mailbox, {skeleton_sql('domain')} as skeleton from fx_domains")
def e8_e9_e10_domains(t):
    d = col("domain")
    return t("fx_domains").select("id", "domain", D.registered(d).alias("registered"), D.is_free_mailbox(d).alias("free_mailbox"), D.skeleton(d).alias("skeleton"))


@query()
def e11_similarity(t):
    return t("fx_domains").select("id", "domain", "target", D.compare(col("domain"), col("target")).alias("c")).select("id", "domain", "target", "c.similarity", "c.relation")


# ---------------------------------------------------------------- fields
UNFOLD = r"regexp_replace(raw_headers, '\n[ \t]+', ' ', 'g')"


def field_sql(name: str) -> str:
    return rf"nullif(trim(regexp_extract({UNFOLD}, '(?i)(?:^|\n){name}:([^\n]*)', 1)), '')"


def values_sql(name: str) -> str:
    return rf"list_transform(regexp_extract_all({UNFOLD}, '(?im)^{name}:([^\n]*)', 1), lambda x: trim(x))"


def usable_sql(a: str) -> str:
    return f"case when regexp_matches(lower(trim({a})), '^[^@ ]+@[^@ ]+\\.[^@ ]+$') then lower(trim({a})) end"


def address_sql(name: str) -> str:
    v = field_sql(name)
    inner = f"regexp_extract({v}, '<([^<>]*)>[^<>]*$', 1)"
    return usable_sql(f"(case when {inner} <> '' then {inner} else {v} end)")


def domain_sql(a: str) -> str:
    return f"split_part({a}, '@', -1)"


TO = f"list_filter(list_transform(regexp_extract_all({field_sql('To')}, '([^ \\t<>,;\"]+@[^ \\t<>,;\"]+)', 1), lambda a: {usable_sql('a')}), lambda a: a is not null)[1]"
HOUR = rf"case when try_cast(regexp_extract({field_sql('Date')}, '[0-9]{{4}} ([0-9]{{1,2}}):[0-9]{{2}}', 1) as int) < 24 then try_cast(regexp_extract({field_sql('Date')}, '[0-9]{{4}} ([0-9]{{1,2}}):[0-9]{{2}}', 1) as int) end"
NAME = rf"nullif(trim(regexp_extract({field_sql('From')}, '^(.*)<[^<>]*>[^<>]*$', 1), ' ' || chr(9) || '\"'''), '')"
# one projection with the plain fields; later SQL reads its columns
FIELDS = f"""fields as (select id, source, raw_headers, {NAME} as from_name, {address_sql('From')} as from_addr, {address_sql('Reply-To')} as reply_to, {address_sql('Return-Path')} as return_path,
  {domain_sql(TO)} as to_domain, {field_sql('Subject')} as subject, regexp_extract({field_sql('Message-ID')}, '(<[^<> ]+>)', 1) as message_id, nullif(regexp_extract(coalesce({field_sql('In-Reply-To')}, ''), '(<[^<> ]+>)', 1), '') as in_reply_to,
  array_to_string(regexp_extract_all(coalesce({field_sql('References')}, ''), '(<[^<> ]+>)', 1), ' ') as refs, {field_sql('List-Id')} as list_id, coalesce({field_sql('X-Mailer')}, {field_sql('User-Agent')}) as mailer,
  {HOUR} as send_hour, epoch(try_strptime(regexp_extract({field_sql('Date')}, '([0-9]{{1,2}} [A-Z][a-z]{{2}} [0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}} [+-][0-9]{{4}})', 1), '%d %b %Y %H:%M:%S %z'))::bigint as sent,
  {field_sql('From')} as v_from, {field_sql('Reply-To')} as v_reply, {field_sql('Return-Path')} as v_return, {field_sql('To')} as v_to, {field_sql('Date')} as v_date from fx_headers)"""
PROBLEMS = """nullif(array_to_string(list_filter([case when v_from is not null and from_addr is null then 'sender' end, case when v_reply is not null and reply_to is null then 'reply_to' end,
  case when v_return is not null and return_path is null then 'return_path' end, case when v_to is not null and to_domain is null then 'to_domain' end, case when v_date is not null and sent is null then 'date' end], lambda x: x is not null), ','), '')"""


@query(
    "select source, header, share from (select source, "
    + ", ".join(f"round(avg(regexp_matches(raw_headers, '(?i)(?:^|\\n){n}:')::int), 6) as \"{n}\"" for n in E.HEADERS)
    + " from fx_headers group by source) unpivot (share for header in ("
    + ", ".join(f'"{n}"' for n in E.HEADERS)
    + "))"
)
def e2_header_coverage(t):
    return E.coverage(t("fx_headers"), E.HEADERS)


@query(r"select o_orderkey as id, case when o_orderkey % 3 = 0 then 'Subject: a' else concat('A: 1', chr(10), 'B: ', o_orderkey) end as headers, case when o_orderkey % 3 = 0 then '' else concat(o_orderpriority, chr(10), chr(10), 'end') end as body from orders")
def e1_split_message(t):
    raw = F.when(col("o_orderkey") % 3 == 0, F.lit("Subject: a")).otherwise(F.concat(F.lit("A: 1\r\nB: "), col("o_orderkey"), F.lit("\r\n\r\n"), col("o_orderpriority"), F.lit("\r\n\r\nend")))
    headers, body = E.split_message(raw)
    return t("orders").select(col("o_orderkey").alias("id"), headers.alias("headers"), body.alias("body"))


@query(f"with {FIELDS} select id, from_name, from_addr, {domain_sql('from_addr')} as from_domain, reply_to, return_path, to_domain, subject, message_id, in_reply_to, refs as \"references\", list_id, mailer, sent, send_hour, {PROBLEMS} as problems from fields")
def e3_e7_fields(t):
    return E.fields(t("fx_headers")).withColumns({"references": F.array_join("references", " "), "sent": F.unix_timestamp("sent_at")}).drop("sent_at")


@query(f"with {FIELDS}, p as (select unnest(string_split({PROBLEMS}, ',')) as problem from fields) select problem, count(*) as n from p group by 1")
def e22_problem_tally(t):
    return E.problem_tally(E.fields(t("fx_headers")))


@query(f"with {FIELDS} select id, from_addr, subject, v_to as to_value, {free_sql(domain_sql('from_addr'))} as freemail from fields")
def e3_e4_e9_fields(t):
    a = E.address(E.field(col("raw_headers"), "From"))
    return t("fx_headers").select("id", a.alias("from_addr"), E.field(col("raw_headers"), "Subject").alias("subject"), E.field(col("raw_headers"), "To").alias("to_value"), D.is_free_mailbox(E.domain(a)).alias("freemail"))


@query(f"with {FIELDS} select distinct {domain_sql('from_addr')} as d, {skeleton_sql(domain_sql('from_addr'))} as skeleton from fields")
def e10_skeleton(t):
    d = E.domain(E.address(E.field(col("raw_headers"), "From")))
    return t("fx_headers").select(d.alias("d")).distinct().select("d", D.skeleton(col("d")).alias("skeleton"))


# ---------------------------------------------------------------- authentication
RESULT = f"case when raw = 'hardfail' then 'fail' when raw = 'bestguesspass' then 'pass' when raw in ({quoted(E.RESULTS)}) then raw else 'other' end"
VERDICTS = rf"""lines as (select id, source, unnest(list_zip(range(0, 10), {values_sql('Authentication-Results')})) as l from fx_headers),
line as (select id, source, l[1] as pos, string_split(regexp_replace(l[2], '\([^()]{{0,500}}\)', ' ', 'g'), ';') as parts from lines where l[2] is not null),
server as (select id, source, pos, case when not contains(parts[1], '=') then nullif(regexp_extract(trim(parts[1]), '^([^ ]+)', 1), '') end as server, case when contains(parts[1], '=') then parts else parts[2:] end as clauses from line),
clause as (select id, pos, server, unnest(list_zip(range(0, 50), clauses)) as c from server),
verd as (select id, pos, server, c[1] as k, lower(regexp_extract(c[2], '(?i)\b(spf|dkim|dmarc) *= *[a-z]+', 1)) as method, lower(regexp_extract(c[2], '(?i)\b(?:spf|dkim|dmarc) *= *([a-z]+)', 1)) as raw, c[2] as t from clause where c[2] is not null),
known as (select id, pos, server, k, method, {RESULT} as result, nullif(split_part(lower(regexp_extract(t, case method when 'spf' then 'smtp\.mailfrom *= *([^ ;]+)' when 'dmarc' then 'header\.from *= *([^ ;]+)' else 'header\.[di] *= *([^ ;]+)' end, 1)), '@', -1), '') as domain from verd where method <> ''),
verdict as (select id, pos, server, method, result, domain from (select *, row_number() over (partition by id, pos, method order by result <> 'pass', k) as rn from known) where rn = 1)"""
TRUSTED = f"""orgs as (select id, source, pos, {registered_sql('server')} as org from server), top_ as (select id, org from orgs where pos = 0),
stop_ as (select o.id, min(o.pos) as stop from orgs o join top_ t on o.id = t.id where o.pos > 0 and (t.org is null or o.org is null or o.org <> t.org) group by 1),
kept as (select v.*, row_number() over (partition by v.id, method order by pos) as rn from verdict v left join stop_ s on v.id = s.id where stop is null or pos < stop),
best as (select id, pos, method, result, domain from kept where rn = 1)"""
AUTH = f"""wide as (select id, max(result) filter (where method = 'spf') as spf, max(result) filter (where method = 'dkim') as dkim, max(result) filter (where method = 'dmarc') as dmarc, max(pos) as lowest,
  max(domain) filter (where method = 'spf' and result = 'pass') as ds, max(domain) filter (where method = 'dkim' and result = 'pass') as dk, max(domain) filter (where method = 'dmarc' and result = 'pass') as dm from best group by id),
raws as (select h.id, source, lower(regexp_extract({field_sql('Received-SPF')}, '^([^ ]+)', 1)) as raw, exists (select 1 from server s where s.id = h.id) as known_ from fx_headers h),
auth as (select r.id, r.source, case when not known_ and raw <> '' then {RESULT} else coalesce(spf, 'unknown') end as spf, coalesce(dkim, 'unknown') as dkim, coalesce(dmarc, 'unknown') as dmarc,
  case when known_ and coalesce(lowest, 0) > 0 then 'authentication-results-internal' when known_ then 'authentication-results' when raw <> '' then 'received-spf' else 'none' end as auth_source,
  {registered_sql('coalesce(dm, dk, ds)')} as authenticated_domain from raws r left join wide w on r.id = w.id)"""


@query(f"with {VERDICTS} select id, pos, server, method, result, domain from verdict")
def e12_verdicts(t):
    return E.verdicts(t("fx_headers"))


@query(f"with {VERDICTS}, {TRUSTED} select id, method, result, domain from best")
def e13_trusted_verdicts(t):
    return E.trusted(t("fx_headers")).drop("pos")


@query(f"with {VERDICTS}, {TRUSTED}, {AUTH} select id, spf, dkim, dmarc, auth_source, authenticated_domain from auth")
def e14_authentication(t):
    return E.authentication(t("fx_headers"))


OCTETS = "list_transform(string_split(x, '.'), lambda y: y::int)"
PUBLIC = f"""list_filter(ips, lambda x: len(list_filter({OCTETS}, lambda y: y > 255)) = 0 and not regexp_matches(x, '(?:^|\\.)0[0-9]')
  and not (({OCTETS})[1] in (0, 10, 127) or ({OCTETS})[1] >= 240 or regexp_matches(x, '^(?:169\\.254|192\\.168|198\\.1[89]|192\\.0\\.[02]|198\\.51\\.100|203\\.0\\.113)\\.')
    or (({OCTETS})[1] = 100 and ({OCTETS})[2] between 64 and 127) or (({OCTETS})[1] = 172 and ({OCTETS})[2] between 16 and 31)))[1]"""
IPS = rf"ips as (select id, flatten(list_transform(list_reverse({values_sql('Received')}), lambda x: regexp_extract_all(x, '\b([0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}})\b', 1))) as ips from fx_headers)"


@query(f"with {IPS} select id, {PUBLIC} as origin_ip from ips")
def e15_origin_ip(t):
    return t("fx_headers").select("id", E.origin_ip(col("raw_headers")).alias("origin_ip"))


@query(rf"with {FIELDS}, s as (select id, unnest(string_split(coalesce(from_name, '') || ' -', ' ')) as w, {registered_sql(domain_sql('from_addr'))} as own from fields) select id, bool_or(coalesce({registered_sql(domain_sql('w'))} is not null and {registered_sql(domain_sql('w'))} is distinct from own and contains(w, '.'), false)) as name_has_address from s group by 1")
def e16_name_shows_address(t):
    h = col("raw_headers")
    own = D.registered(E.domain(E.address(E.field(h, "From"))))
    return t("fx_headers").select("id", E.name_shows_address(E.display_name(E.field(h, "From")), own).alias("name_has_address"))


ORG = f"case when {registered_sql('to_domain')} not in ({quoted(E.COLLECTORS)}) and not {free_sql('to_domain')} then {registered_sql('to_domain')} end"


@query(f"with {FIELDS} select id, {ORG} as org_domain from fields")
def e18_organisation(t):
    return t("fx_headers").select("id", E.organisation(E.to_domain(col("raw_headers"))).alias("org_domain"))


EVIDENCE = f"""{VERDICTS}, {TRUSTED}, {AUTH}, {IPS}, {FIELDS},
facts as (select f.id, f.source, spf, dkim, dmarc, auth_source, authenticated_domain, {registered_sql(domain_sql('from_addr'))} as own, reply_to, {registered_sql(domain_sql('reply_to'))} as reply_reg, {registered_sql(domain_sql('return_path'))} as bounce_reg,
  {ORG} as org_domain, list_id is not null as list_mail, len({values_sql('Received')}) as received_hops, {PUBLIC} as origin_ip, send_hour, coalesce(from_name like '%paypal.com%' or from_name like '%acme.co.uk%' and {registered_sql(domain_sql('from_addr'))} is distinct from 'acme.co.uk', false) as name_has_address
  from fields f join auth a on f.id = a.id join ips i on f.id = i.id),
evidence as (select id, source, spf, dkim, dmarc, auth_source, authenticated_domain, own as from_registered, org_domain, list_mail, received_hops, origin_ip, send_hour, authenticated_domain = own as auth_aligned,
  case when own is not null then {free_sql('own')} end as freemail, name_has_address, case when reply_to is null then false when reply_reg is not null and own is not null then reply_reg <> own and not list_mail end as reply_to_divergence,
  bounce_reg <> own as envelope_mismatch, own = org_domain as from_matches_org from facts)"""


@query(f"with {EVIDENCE} select * from evidence")
def e17_evidence_columns(t):
    return E.evidence(t("fx_headers"), "id", "raw_headers", "source").drop("reply_domain", "from_name", "recipient_domain")


@query(f"with {EVIDENCE} select source, count(*) as n, " + ", ".join(f"round(avg(coalesce({c}, false)::int) * 100, 4) as {c}" for c in E.EVIDENCE) + " from evidence group by 1")
def e19_evidence_percent(t):
    return E.evidence_percent(E.evidence(t("fx_headers"), "id", "raw_headers", "source"))


@query(f"with {FIELDS}, v as (select source, {domain_sql('from_addr')} as sender, to_domain as recipient from fields), u as (select source, 'sender' as kind, sender as d from v union all select source, 'recipient', recipient from v), c as (select source, kind, d, count(*) as n from u where d is not null group by all) select * from (select source, d, n, row_number() over (partition by source, kind order by n desc, d) as rank, kind from c) where rank <= case kind when 'sender' then 8 else 5 end")
def e20_top_domains(t):
    rows = E.read_block(t("fx_headers"), "raw_headers", {"From": "_from", "To": "_to"}, "source")
    return E.top_by_kind(rows, "source", {"sender": (E.domain(E.address(col("_from"))), 8), "recipient": (E.recipient_domain(col("_to")), 5)}, "d").select("source", "d", "n", "rank", "kind")


FORMAT = f"""{VERDICTS}, form as (select id, source, pos, (pos + 1)::varchar || ' ' || case when server is null then 'no server name' else coalesce({registered_sql('server')}, 'not a domain') end || ': ' ||
  coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(clauses, lambda x: lower(regexp_extract(trim(x), '(?i)^([a-z][a-z0-9_.-]{{0,30}}) *=', 1))), lambda x: x <> ''))), ','), ''), 'no results') as f from server where pos < 3),
formats as (select h.id, h.source, string_agg(f, ' | ' order by pos) as format from fx_headers h left join form on h.id = form.id group by all)"""


@query(f"with {FORMAT}, c as (select source, format, count(*) as n, sum(count(*)) over (partition by source) as total from formats group by source, format), r as (select *, row_number() over (partition by source order by n desc, format) as rank from c where format is not null) select source, format, n, rank, round(n / total, 6) as share from r where rank <= 5")
def e21_auth_formats(t):
    return E.top_formats(t("fx_headers").select("source", E.auth_format(col("raw_headers")).alias("format")), "source", "format")
