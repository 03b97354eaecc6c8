"""Queries over message text: cleaning, quotes, signatures and redaction, in the registry of ``letterspark.queries``."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from letterspark.functions import text as T
from letterspark.header_queries import registered_sql
from letterspark.queries import query

col = F.col
NL = r"regexp_replace(text, '\r\n?', chr(10), 'g')"


def lit(pattern: str) -> str:
    """A pattern as an SQL string; bounds of repeats over 19, which only guard against hostile text, are open in it."""
    free = re.sub(r"\{([01]),([0-9]{2,})\}", lambda m: ("*" if m[1] == "0" else "+") if int(m[2]) > 19 else m[0], pattern)
    return "'" + free.replace("'", "''") + "'"


@query(f"select doc_id, substr({NL}, 1, 1000) as text, length({NL}) > 1000 as truncated from documents")
def d1_newlines_and_cap(t):
    text, more = T.capped(col("text"), 1000)
    return t("documents").select("doc_id", text.alias("text"), more.alias("truncated"))


@query(r"select page_id, n, regexp_matches(x, '(?i)<[ \t\n]{0,10}/?[ \t\n]{0,10}(?:html|head|body|div|p|br|table|tr|td|span|font|a|img|style|center|b|i|ul|li|h[1-6]|blockquote)\b') as is_html from (select page_id, unnest([0, 1]) as n, unnest([html, regexp_replace(html, '<[^ap/]', 'x <john@x.org> ', 'g')[1:40]]) as x from pages)")
def d2_looks_like_html(t):
    some = F.substring(F.regexp_replace("html", "<[^ap/]", "x <john@x.org> "), 1, 40)
    rows = t("pages").select("page_id", F.posexplode(F.array(col("html"), some)).alias("n", "x"))
    return rows.select("page_id", "n", T.looks_like_html(col("x")).alias("is_html"))


def entities_sql(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&euro;", "€"), ("&pound;", "£"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def numeric_sql(x: str) -> str:
    """The two numeric references that the view holds."""
    return f"replace(replace({x}, '&#233;', 'é'), '&#x41;', 'A')"


def html_sql(x: str) -> str:
    s = f"regexp_replace({x}, '(?is)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "head", "noscript", "title"):
        s = rf"regexp_replace({s}, '(?is)<{tag}(?:[ \t\n][^>]*)?>.*?</{tag}>', '', 'g')"
    for _ in range(4):
        s = rf"regexp_replace({s}, '(?is)<blockquote(?:[ \t\n][^>]*)?>(?:[^<]|<[^/b]|<b[^l]|</[^b]|</b[^l])*</blockquote>', '', 'g')"
    s = rf"""regexp_replace({s}, '(?is)<a[ \t\n][^>]*?href="((?:https?://|www\.|mailto:)[^"]{{0,500}})"[^>]*>(.*?)</a>', '\2 (\1)', 'g')"""
    s = rf"regexp_replace({s}, {lit(T.BLOCK + '[^>]*>')}, chr(10), 'g')"
    s = entities_sql(numeric_sql(rf"regexp_replace({s}, '<[^>]*>', ' ', 'g')"))
    return rf"regexp_replace(regexp_replace({s}, '[ \t]*\n[ \t\n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


NUMBERED = "concat(html, '<p>caf&#233; &#x41;<blockquote>a<blockquote>b</blockquote>c</blockquote><a href=\"http://x.com/a\">here</a>')"


@query(f"select page_id, {html_sql(NUMBERED)} as text from pages")
def d3_html_to_text(t):
    return t("pages").select("page_id", T.html_to_text(F.expr(NUMBERED)).alias("text"))


@query(r"select doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) as text, len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')) as n_words from documents")
def d7_d18_squeeze(t):
    return t("documents").select("doc_id", T.squeeze(col("text")).alias("text"), T.word_count(col("text")).alias("n_words"))


# one stage of cleaning after the other
SQUEEZE = r"trim(regexp_replace({}, '[ \t\r\n]+', ' ', 'g'))"
PLAIN = rf"""raw as (select doc_id, source, substr({NL}, 1, {T.MOST}) as raw, doc_id % 9 = 7 as is_html from fx_mail),
body as (select *, case when is_html then {html_sql('raw')} else {entities_sql('raw')} end as b from raw),
word as (select *, case when regexp_matches(b, '(?i)\b(?:unsubscribe|mailing list)\b') then length(regexp_extract(b, '(?is)^(.*)\b(?:unsubscribe|mailing list)\b', 1)) end as n from body),
window_ as (select *, greatest(0, n - 300) as s, substr(b, greatest(0, n - 300)::bigint + 1, (n - greatest(0, n - 300))::bigint) as w from word),
sep as (select *, case when regexp_matches(w, '[-_=*]{{10,}}') then s + length(regexp_extract(w, '(?s)^(.*?)[-_=*]{{10,}}', 1)) end as cut_at from window_),
plain as (select doc_id, source, raw, is_html, coalesce(cut_at is not null and length(b) - cut_at <= 1500, false) as removed, case when cut_at is not null and length(b) - cut_at <= 1500 then substr(b, 1, cut_at::bigint) else b end as t from sep)"""


def place_sql(x: str, pattern: str) -> str:
    flags, bare = ("i", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return f"case when regexp_matches({x}, {lit(pattern)}) then length(regexp_extract({x}, {lit(f"(?s{flags})^(.*?)(?:{bare})")}, 1)) + 1 end"


MARKED = f"""marks as (select *, least({", ".join(place_sql("t", m) for m in T.MARKERS)}) as first, least({", ".join(place_sql("t", m) for k, m in enumerate(T.MARKERS) if k != T.WROTE)}) as whole from plain),
head as (select *, string_split(case when first is null then t else substr(t, 1, first - 1) end, chr(10)) as lines, case when first is null then '' else substr(t, first) end as rest from marks),
cut as (select *, array_to_string(list_filter(lines, lambda x: not regexp_matches(x, '^[ \\t]*>')), chr(10)) as m, array_to_string(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t]*>')), chr(10)) || rest as q from head),
quoted as (select *, case when regexp_matches(m, '[\\p{{L}}\\p{{N}}]') then m else t end as main, case when regexp_matches(m, '[\\p{{L}}\\p{{N}}]') then q else '' end as history from cut)"""
SIGNED = f"""trimmed as (select *, list_filter(list_transform(string_split(main, chr(10)), lambda x: regexp_replace(x, '^[ \\t]+|[ \\t]+$', '', 'g')), lambda x: x <> '') as ls from quoted),
ends as (select *, list_min(list_filter(list_transform(range(1, len(ls) + 1), lambda i: case when regexp_matches(ls[i], '^-- ?$') then i end), lambda i: i is not null)) as dashes,
  list_max(list_filter(list_transform(range(1, len(ls) + 1), lambda i: case when i > len(ls) - 12 and regexp_matches(ls[i], {lit(T.CLOSING)}) then i end), lambda i: i is not null)) as closing from trimmed),
signed as (select *, array_to_string(case when dashes is not null then ls[dashes + 1 : dashes + 8] when closing is not null then ls[closing : closing + 8] else [] end, chr(10)) as signature from ends)"""


@query(f"with {PLAIN} select doc_id, t as text, removed from plain")
def d4_without_footer(t):
    return t("fx_mail").select("doc_id", T._plain(col("text")).alias("p")).select("doc_id", "p.text", "p.removed")


@query(f"with {PLAIN}, {MARKED} select doc_id, main, history as quoted from quoted")
def d5_split_quoted(t):
    return t("fx_mail").select("doc_id", T._plain(col("text")).alias("p")).select("doc_id", T.split_quoted(col("p.text")).alias("q")).select("doc_id", "q.main", "q.quoted")


@query(f"with {PLAIN}, {MARKED}, {SIGNED} select doc_id, signature from signed")
def d6_signature(t):
    rows = t("fx_mail").select("doc_id", T._plain(col("text")).alias("p")).select("doc_id", T.split_quoted(col("p.text")).alias("q"))
    return rows.select("doc_id", T.signature(col("q.main")).alias("signature"))


CLEAN = f"""{PLAIN}, {MARKED}, {SIGNED}, clean as (select doc_id, source, {SQUEEZE.format('main')} as body_clean, {SQUEEZE.format('signature')} as signature, is_html as was_html, is_html and contains(raw, '<blockquote') or trim(history, ' ' || chr(9) || chr(10)) <> '' as quote_removed, removed as footer_removed, false as truncated from signed)"""


@query(f"with {CLEAN} select doc_id, body_clean, signature, was_html, quote_removed, footer_removed, truncated from clean")
def d8_clean(t):
    return t("fx_mail").select("doc_id", T.clean(col("text")).alias("c")).select("doc_id", "c.*")


@query(f"""with {PLAIN}, {MARKED}, tails as (select *, array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \\t]*>')), lambda x: regexp_replace(x, '^[ \\t]*[> \\t]+', '')), ' ') as marked, case when first = whole then substr(t, first) end as tail from quoted)
select doc_id, {SQUEEZE.format('main')} as text, {SQUEEZE.format("concat_ws(' ', marked, tail)")} as quoted, {SQUEEZE.format('t')} as "full" from tails""")
def d17_split_message(t):
    return t("fx_mail").select("doc_id", T.split_message(col("text")).alias("m")).select("doc_id", "m.*")


def redact_sql() -> str:
    """Stages of redaction; domains are put back together from the pieces between candidates."""
    steps, before = [], "fx_mail"
    counts: list[str] = []
    for name, plain, spaced in T.KINDS:
        low = name.lower()
        keep = ", ".join(["doc_id", "source", *counts])
        if plain:
            steps.append(f"{low}_a as (select {keep}, len(regexp_extract_all(text, {lit(plain)})) as n_{low}, regexp_replace(text, {lit(plain)}, '[{name}]', 'g') as text from {before})")
        else:
            found = f"regexp_extract_all(text, {lit(T.CANDIDATE)}, 1)"
            steps.append(f"{low}_c as (select *, {found} as found, regexp_split_to_array(text, {lit(T.CANDIDATE)}) as parts from {before})")
            steps.append(f"{low}_u as (select doc_id, k, {registered_sql('d')} is not null as real, d from (select doc_id, unnest(range(1, len(found) + 1)) as k, unnest(found) as d from {low}_c))")
            steps.append(f"{low}_l as (select doc_id, count(*) filter (where real) as n, list(case when real then '[DOMAIN]' else d end order by k) as ds from {low}_u group by 1)")
            steps.append(f"{low}_a as (select {', '.join('c.' + x for x in ['doc_id', 'source', *counts])}, coalesce(l.n, 0) as n_{low}, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(l.ds[i], '')), '') as text from {low}_c c left join {low}_l l on c.doc_id = l.doc_id)")
        steps.append(f"{low}_b as (select {keep}, n_{low} + len(regexp_extract_all(text, {lit(spaced)})) as n_{low}, regexp_replace(text, {lit(spaced)}, '[{name}]', 'g') as text from {low}_a)")
        before = f"{low}_b"
        counts.append(f"n_{low}")
    return ", ".join(steps)


REDACTED = f"{redact_sql()}, redacted as (select * from domain_b)"


@query(f"with {REDACTED} select doc_id, text, n_url, n_email, n_file, n_domain from redacted")
def d9_redact(t):
    return t("fx_mail").select("doc_id", T.redaction(col("text")).alias("r")).select("doc_id", "r.*")


@query(f"with c as (select doc_id, unnest(regexp_extract_all(text, {lit(T.CANDIDATE)}, 1)) as d from fx_mail) select doc_id, d as domain, count(*) as n from c where {registered_sql('d')} is not null group by all")
def d10_real_domains(t):
    return t("fx_mail").select("doc_id", F.explode(T.real_domains(col("text"))).alias("domain")).groupBy("doc_id", "domain").agg(F.count("*").alias("n"))


LINK = f"(regexp_matches(text, {lit(T.URL)}) or regexp_matches(text, {lit(T.SPACED_URL)}))"


@query(f"""with {CLEAN}, m as (select doc_id, {LINK} as has_link from fx_mail)
select source, count(*) as n, count(*) filter (where has_link) as links, count(*) filter (where was_html) as html, round(avg(quote_removed::int), 6) as quotes, round(avg(footer_removed::int), 6) as footers, count(*) filter (where signature <> '') as signatures, count(*) filter (where body_clean = '') as empty, round(avg(length(body_clean)), 4) as mean_chars
from clean join m using (doc_id) group by source""")
def d11_d13_link_summary(t):
    rows = t("fx_mail").select("source", T.has_link(col("text")).alias("has_link"), T.clean(col("text")).alias("c")).select("source", "has_link", "c.*")
    share = lambda c: F.round(F.avg(col(c).cast("int")), 6)
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("has_link").alias("links"), F.count_if("was_html").alias("html"), share("quote_removed").alias("quotes"), share("footer_removed").alias("footers"),
        F.count_if(col("signature") != "").alias("signatures"), F.count_if(col("body_clean") == "").alias("empty"), F.round(F.avg(F.length("body_clean")), 4).alias("mean_chars"),
    )


@query(f"select d.doc_id, {LINK.replace('text', 'd.text')} or coalesce(l.toxic = 1, false) as has_link from fx_mail d left join labels l on d.doc_id = l.doc_id")
def d12_link_or_flag(t):
    flags = t("labels").select("doc_id", (col("toxic") == 1).alias("flag"))
    return t("fx_mail").join(flags, "doc_id", "left").select("doc_id", (T.has_link(col("text")) | F.coalesce("flag", F.lit(False))).alias("has_link"))


LEFT = {"url": r"(?i)\b(?:https?|ftp)\b", "email": "@", "file": r"(?i)\.(?:pdf|docm|exe)\b", "domain": r"(?i)[a-z0-9]\.(?:com|org|net)\b"}


@query(f"with {REDACTED} select source, count(*) as n, " + ", ".join(f"count(*) filter (where regexp_matches(text, {lit(p)})) as left_{k}" for k, p in LEFT.items()) + " from redacted group by 1")
def d14_leftovers(t):
    rows = t("fx_mail").select("source", T.redact(col("text")).alias("r"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), *(F.count_if(col("r").rlike(p)).alias(f"left_{k}") for k, p in LEFT.items()))


@query(f"""with m as (select doc_id, source, {LINK} as has_link from fx_mail), x as (select m.*, d.category, case when m.doc_id % 20 = 0 then 'test' when m.doc_id % 20 < 4 then 'validation' else 'train' end as split from m join fx_docs d using (doc_id))
select category, split, count(*) filter (where not has_link) as link_free, count(*) filter (where has_link) as linked from x group by all""")
def d15_links_by_split(t):
    split = F.when(col("doc_id") % 20 == 0, "test").when(col("doc_id") % 20 < 4, "validation").otherwise("train")
    rows = t("fx_mail").select("doc_id", T.has_link(col("text")).alias("l")).join(t("fx_docs").select("doc_id", "category"), "doc_id").withColumn("split", split)
    return rows.groupBy("category", "split").agg(F.count_if(~col("l")).alias("link_free"), F.count_if("l").alias("linked"))


@query(r"select doc_id, translate(case when length(text) > 2000 then regexp_replace(substr(text, 1, 2000), ' [^ ]*$', '') else text end, '<>', '()') as text from documents")
def d16_model_text(t):
    return t("documents").select("doc_id", T.model_text(col("text")).alias("text"))


@query(r"select doc_id, translate(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '<>', '()') as text from fx_mail")
def d19_display_safe(t):
    return t("fx_mail").select("doc_id", T.display_safe(col("text")).alias("text"))
