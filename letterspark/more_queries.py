"""Further operator queries, in the registry of ``letterspark.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators import compare as X
from letterspark.operators import labels as G
from letterspark.operators import scoring as K
from letterspark import annotation_queries, bank_queries, claim_queries, classify_queries, header_queries, report_queries, rule_queries, takeover_queries, text_queries, thread_queries, world_queries  # noqa: F401  they register their queries
from letterspark.queries import ORACLE_SQL, QUERIES, SCORED, WILSON, query
from letterspark.sources import messages as A

__all__ = ["ORACLE_SQL", "QUERIES"]

col = F.col


# ---------------------------------------------------------------- sources
@query("select doc_id, text, 'documents' as source, 0 as source_rank from documents union all select item_id, text, 'benchmark', 1 from benchmark")
def a4_union_of_sources(t):
    return A.union_of_sources([("documents", t("documents").select("doc_id", "text")), ("benchmark", t("benchmark").select(col("item_id").alias("doc_id"), "text"))])


@query("select doc_id, source, n_chars from documents where lang = 'en'")
def a5_split_scan(t):
    return A.split_scan(t("documents"), "en", ["doc_id", "source", "n_chars"], "lang")


@query("select doc_id, n_chars from documents where doc_id not in (select doc_id from labels where quality = 1)")
def a8_missing_keys(t):
    store = t("labels").withColumn("version", F.when(col("quality") == 1, "v2").otherwise("v1"))
    return A.missing_keys(t("documents").select("doc_id", "n_chars"), store, "doc_id", "v2")


@query(r"""with c as (select o_orderkey, case o_orderkey % 4 when 0 then '' when 1 then o_custkey::varchar when 2 then lpad(o_custkey::varchar, 9, '0') else o_orderpriority end as x from orders)
select o_orderkey, nullif(x, '') as cell, case when regexp_matches(x, '^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$') then try_cast(x as double) end as number from c""")
def a9_typed_cells(t):
    k = col("o_orderkey") % 4
    x = F.when(k == 0, "").when(k == 1, col("o_custkey").cast("string")).when(k == 2, F.lpad(col("o_custkey").cast("string"), 9, "0")).otherwise(col("o_orderpriority"))
    cell, number = A.typed_cell(x)
    return t("orders").select("o_orderkey", cell.alias("cell"), number.alias("number"))


# ---------------------------------------------------------------- text
@query("select category, count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'de') as de, count(*) filter (where lang = 'fr') as fr, count(*) filter (where coalesce(lang, '') not in ('en', 'de', 'fr')) as other from fx_docs group by 1")
def d15_contingency(t):
    lang = F.when(col("lang").isin("en", "de", "fr"), col("lang")).otherwise("other")  # null included: the cells add up to the documents
    return t("fx_docs").withColumn("_lang", lang).groupBy("category").pivot("_lang", ["en", "de", "fr", "other"]).agg(F.count(F.lit(1))).fillna(0)


# ---------------------------------------------------------------- labels
@query("select user_id as item, arg_max(case when value >= 50 then value end, case when value >= 50 then event_id end) as answer, count(*) filter (where not value >= 50) as refused from events group by 1")
def g5_latest_valid(t):
    return G.latest_valid(t("events").withColumnRenamed("user_id", "item"), "item", "event_id", col("value") >= 50, "value")


WORDS = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


OTHER = "case when position % 3 = 1 then substring(text, 5, 40) when position % 3 = 2 then concat(text, ' with more words') else quoted end"


@query(rf"""with y as (select msg_key, text, {OTHER} as other from fx_messages), x as (select msg_key, {WORDS.format('text')} as a, {WORDS.format('other')} as b from y where other is not null),
n as (select *, ' ' || array_to_string(a, ' ') || ' ' as sa, ' ' || array_to_string(b, ' ') || ' ' as sb, len(list_distinct(list_intersect(a, b))) as i, len(list_distinct(list_concat(a, b))) as u from x)
select msg_key, contains(sa, sb) or contains(sb, sa) or case when u > 0 then i / u >= 0.5 else false end as overlap from n""")
def g8_span_overlap(t):
    rows = t("fx_messages").select("msg_key", "text", F.expr(OTHER).alias("other")).where("other is not null")
    return rows.select("msg_key", G.spans_overlap(col("text"), col("other")).alias("overlap"))


@query("""select case when grouping(lang) = 0 then 'lang:' || lang when grouping(source) = 0 then 'source:' || source else 'all' end as scope, sum(toxic)::bigint as positives, sum(toxic) < 10 as rare
from labels l join documents d on l.doc_id = d.doc_id group by grouping sets ((), (lang), (source))""")
def g11_positive_counts(t):
    return G.positive_counts(t("labels").join(t("documents").select("doc_id", "lang", "source"), "doc_id"), "toxic", ("lang", "source"))


@query("select d.source, count(*) filter (where toxic = 1) as pos, count(*) filter (where toxic = 0) as neg, case when count(*) filter (where toxic = 1) > 0 then least(10.0, round(count(*) filter (where toxic = 0) / count(*) filter (where toxic = 1), 6)) else 10.0 end as weight from labels l join documents d on l.doc_id = d.doc_id group by 1")
def l22_class_weights(t):
    return G.class_weights(t("labels").join(t("documents").select("doc_id", "source"), "doc_id"), "source", "toxic", 10.0)


@query("""with x as (select event_id // 4 as user_id, event_type as label, max(value) >= 60 as y, min(value) < 30 as p from events group by event_id // 4, event_type)
select m.label as missed, w.label as given, count(*) as n from x m join x w on m.user_id = w.user_id where m.y and not m.p and not w.y and w.p group by all""")
def l10_confusion_pairs(t):
    x = t("events").groupBy(F.floor(col("event_id") / 4).alias("user_id"), col("event_type").alias("label")).agg((F.max("value") >= 60).alias("y"), (F.min("value") < 30).alias("p"))
    return G.confusion_pairs(x, "user_id", "label", col("y"), col("p"))


# ---------------------------------------------------------------- ledger, score
DIGITS = "lpad(c_custkey::varchar, 18, '7')"


@query(f"select c_custkey, 'DE' || lpad((98 - ({DIGITS} || '131400')::hugeint % 97)::varchar, 2, '0') || {DIGITS} as account, true as valid, false as changed_valid from customer")
def j23_i11_account_numbers(t):
    number = X.account_number("DE", F.lpad(col("c_custkey").cast("string"), 18, "7"))
    rows = t("customer").select("c_custkey", number.alias("account"))
    last = F.translate(F.right("account", F.lit(1)), "0123456789", "1234567890")
    changed = F.concat(F.substring("account", 1, 21), last)
    return rows.select("c_custkey", "account", X.valid_account_number(col("account")).alias("valid"), X.valid_account_number(changed).alias("changed_valid"))


@query("select msg_id, claim_type, min(substr(claim_id, 2)::int) as first from fx_ledger group by all")
def j10_request_novelty(t):
    return X.novelty(t("fx_ledger").withColumn("position", F.expr("int(substr(claim_id, 2))")), "msg_id", "claim_type", "position")


@query("select event_id, round(value / 100, 4) >= round(0.5, 4) as fired from events")
def k4_fired(t):
    return t("events").select("event_id", (F.round(col("value") / 100, 4) >= F.round(F.lit(0.5), 4)).alias("fired"))


RULES = [f"r{k}" for k in range(9)]


@query("select msg_id, " + ", ".join(f"max(case when contradiction and rule = '{r}' then 1 else 0 end) as rule_{r}" for r in RULES) + ", max(case severity when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end) as worst, count(contradiction) as n_checked, count(*) filter (where contradiction) as n_contradicted from fx_ledger group by 1")
def k6_flat_features(t):
    return X.flat_features(t("fx_ledger"), RULES)


@query(f"with {SCORED} select case when grouping(o_orderpriority) = 1 then 'all' else o_orderpriority end as source, case when grouping(o_orderstatus) = 1 then 'all' else o_orderstatus end as category, count(*) as n, round(avg(score), 6) as mean_score, max(score) as largest from banded join orders on msg_id = o_orderkey group by cube (o_orderpriority, o_orderstatus)")
def k12_distribution(t):
    o = t("orders").select(col("o_orderkey").alias("msg_id"), col("o_orderpriority").alias("source"), col("o_orderstatus").alias("category"))
    return X.distribution(K.score(t("fx_ledger")).join(o, "msg_id"), "source", "category", "score")


HEADER_ONLY = SCORED.replace("from fx_ledger where contradiction", "from fx_ledger where contradiction and verifier = 'header'").replace("(select distinct msg_id from fx_ledger)", "(select distinct msg_id from fx_ledger where verifier = 'header')")


def _both(sql: str) -> str:
    other = HEADER_ONLY
    for name in ("groups_", "raw", "scored", "banded"):
        other = other.replace(f"{name} as (", f"h_{name} as (").replace(f"from {name})", f"from h_{name})").replace(f"from {name} ", f"from h_{name} ").replace(f"join {name} ", f"join h_{name} ")
    return f"with {SCORED}, {other} {sql}"


@query(_both("select case when h.msg_id is null then 'only a' when b.score = h.score then 'same' else 'differs' end as state, count(*) as n from banded b left join h_banded h on b.msg_id = h.msg_id group by 1"))
def k14_parity(t):
    ledger = t("fx_ledger")
    return X.parity(K.score(ledger), K.score(ledger.where("verifier = 'header'")), "msg_id", "score")


@query(_both("select b.band as band_before, h.band as band_after, count(*) as n, round(avg(h.score - b.score), 6) as mean_change from banded b join h_banded h on b.msg_id = h.msg_id group by all"))
def k13_l17_transitions(t):
    ledger = t("fx_ledger")
    return X.transitions(K.score(ledger), K.score(ledger.where("verifier = 'header'")), "msg_id")


@query(f"with g as (select event_type, count(*)::double as n, count(*) filter (where value >= 50)::double as a from events group by 1) select event_type, {WILSON.format(s='-1 *')} as low, {WILSON.format(s='')} as high from g")
def l4_wilson(t):
    g = t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(col("value") >= 50).alias("a"))
    low, high = K.wilson(col("a"), col("n"))
    return g.select("event_type", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
