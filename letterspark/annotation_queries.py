"""Queries over annotators' replies and evaluation by system, in the registry of ``letterspark.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.operators import annotations as G
from letterspark.operators import scoring as K
from letterspark.operators import splits as C
from letterspark.queries import WILSON, query

col = F.col
# a reply for each twenty ids: every 13th item has a key of another name, every 17th a 2, every 19th a wrong id, every 23rd comes twice, every 29th not at all
NAMES = ("spam", "toxic")


def _replies(t):
    one = F.struct(
        F.when(col("doc_id") % 19 == 3, F.concat(F.lit("x"), col("doc_id"))).otherwise(col("doc_id").cast("string")).alias("id"),
        F.create_map(F.when(col("doc_id") % 13 == 4, "junk").otherwise("spam"), F.when(col("doc_id") % 17 == 5, 2).otherwise(1 - col("quality")), F.lit("toxic"), col("toxic")).alias("labels"),
        F.array(F.struct(F.when(col("doc_id") % 7 == 2, "rumour").otherwise("authority").alias("type"), F.when(col("doc_id") % 5 == 1, "words that are nowhere").otherwise(F.substring_index("text", " ", 3)).alias("text"))).alias("claims"),
    )
    rows = t("labels").join(t("documents").select("doc_id", "text"), "doc_id").where("doc_id % 29 <> 6")
    twice = rows.withColumn("copy", F.explode(F.when(col("doc_id") % 23 == 8, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    packed = twice.groupBy(F.floor(col("doc_id") / 20).alias("batch")).agg(F.to_json(F.collect_list(one)).alias("json"))
    return packed.select("batch", F.when(col("batch") % 6 == 1, "I can't do that.").otherwise(F.concat(F.lit("Here you are:\n```json\n{\"items\": "), "json", F.lit("}\n```\nAnything else?"))).alias("reply"))


ANSWERS = """rows_ as (select l.*, d.text, doc_id // 20 as batch from labels l join documents d using (doc_id)), some_ as (select *, unnest(case when doc_id % 23 = 8 then [1, 2] else [1] end) as copy from rows_ where doc_id % 29 <> 6 and batch % 6 <> 1),
given as (select batch, case when doc_id % 19 = 3 then 'x' || doc_id else doc_id::varchar end as id, doc_id, case when doc_id % 13 = 4 then 'junk' else 'spam' end as k, case when doc_id % 17 = 5 then 2 else 1 - quality end as spam, toxic, text from some_)"""


@query(f"with {ANSWERS} select batch, id, k as first_key, spam as first_value, toxic from given union all select distinct batch, null, null, null, null from rows_ where batch % 6 = 1 and doc_id % 29 <> 6")
def g1_items(t):
    rows = G.items(_replies(t))
    first = F.array_max(F.filter(F.map_keys("labels"), lambda k: k != "toxic"))
    return rows.select("batch", "id", first.alias("first_key"), F.get(F.transform(F.filter(F.map_entries("labels"), lambda e: e["key"] != "toxic"), lambda e: e["value"]), F.lit(0)).alias("first_value"), F.try_element_at("labels", F.lit("toxic")).alias("toxic"))


SAID = r"(' ' || array_to_string(list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), ' ') || ' ')"
FIRST3 = "case when doc_id % 5 = 1 then 'words that are nowhere' else array_to_string(string_split(text, ' ')[1:3], ' ') end"


@query(rf"""with {ANSWERS}, j as (select *, {FIRST3} as span from given),
p as (select batch, id, unnest(list_filter([case when k = 'junk' then 'keys' end, case when spam = 2 then 'values' end, case when doc_id % 7 = 2 then 'claim type' end, case when length(span) > 300 then 'long span' end, case when doc_id % 19 <> 3 and not contains({SAID.format('text')}, {SAID.format('span')}) then 'span not in text' end], lambda x: x is not null)) as problem from j)
select * from p union all select distinct batch, null, unnest(['no items', 'keys']) from rows_ where batch % 6 = 1 and doc_id % 29 <> 6""")
def g2_g3_item_problems(t):
    return G.item_problems(G.items(_replies(t)), NAMES, ("authority",), t("documents"), key="doc_id")


@query(f"""with {ANSWERS}, n as (select batch, id, count(*) as n from given group by all), want as (select batch, doc_id::varchar as id from rows_),
a as (select batch, count(*) as n, count(distinct k || '=' || spam || ',' || toxic) as d from given group by 1)
select batch, id, 'unknown id' as problem from n where not exists (select 1 from want w where w.batch = n.batch and w.id = n.id) union all select batch, id, 'id twice' from n where n > 1
union all select batch, id, 'missing id' from want w where not exists (select 1 from n where w.batch = n.batch and w.id = n.id) union all select batch, null, 'equal answers' from a where n > 1 and d = 1""")
def g4_reply_problems(t):
    want = t("labels").join(t("documents").select("doc_id"), "doc_id").select(F.floor(col("doc_id") / 20).alias("batch"), col("doc_id").cast("string").alias("id"))
    return G.reply_problems(G.items(_replies(t)), want)


@query("""with u as (select event_id // 3 as user_id, event_type as technique from events), h as (select user_id, max(case when technique in ('click', 'error') then 1 end) as pressure, max(case when technique = 'purchase' then 1 end) as gain from u group by 1)
select user_id, coalesce(pressure, 0) as pressure, gain from h""")
def g12_taxonomy(t):
    rows = t("events").select(F.floor(col("event_id") / 3).alias("user_id"), col("event_type").alias("technique"))
    mapping = rows.sparkSession.createDataFrame([("click", "pressure", True), ("error", "pressure", False), ("purchase", "gain", False)], "technique string, target string, direct boolean")
    return G.map_taxonomy(rows, mapping, ("pressure", "gain"), "user_id")


@query(r"""with p as (select conv_id, turn % 2 as s, min(turn) as t from conversations where turn < 2 group by all), x as (select c.conv_id as pair, case when c.turn = 0 then 'attack' else 'twin' end as side, case when conv_id % 5 = 1 then 'same for both' when conv_id % 7 = 2 then text || ' see www.x.com/a' else text end as text, conv_id from conversations c where turn < 2),
n as (select *, len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')) as n from x),
b as (select pair, side, unnest(list_filter([case when n < 5 or n > 60 then 'words' end, case when regexp_matches(text, '(?i)\b(?:https?://|www\.)') then 'link' end, case when side = 'attack' and conv_id % 3 = 0 then 'claims missing' end, case when side = 'twin' and conv_id % 4 = 0 then 'twin fires' end], lambda v: v is not null)) as problem from n)
select * from b union all select pair, 'both', 'equal bodies' from x group by pair having count(*) > 1 and count(distinct text) = 1""")
def g13_pair_problems(t):
    c = t("conversations").where("turn < 2")
    text = F.when(col("conv_id") % 5 == 1, "same for both").when(col("conv_id") % 7 == 2, F.concat("text", F.lit(" see www.x.com/a"))).otherwise(col("text"))
    pairs = c.select(col("conv_id").alias("pair"), F.when(col("turn") == 0, "attack").otherwise("twin").alias("side"), text.alias("text"), F.array(F.lit("a"), F.lit("b")).alias("wanted"),
                     F.when(col("conv_id") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("found"), (col("conv_id") % 4 == 0).alias("fired"))
    return G.pair_problems(pairs, 5, 60)


@query("""with x as (select * from labels union all select * from labels where doc_id % 50 = 0), n as (select doc_id, count(*) as n from x group by 1)
select 'repeated ids' as "check", count(*) filter (where n > 1) as value, case when count(*) filter (where n > 1) = 0 then 'PASS' else 'FAIL' end as status from n
union all select 'test rows', count(*) filter (where doc_id % 9 = 0), case when count(*) filter (where doc_id % 9 = 0) = 0 then 'PASS' else 'FAIL' end from x
union all select 'toxic not binary', count(*) filter (where toxic not in (0, 1) or toxic is null), case when count(*) filter (where toxic not in (0, 1) or toxic is null) = 0 then 'PASS' else 'FAIL' end from x""")
def g14_training_checks(t):
    x = t("labels").unionByName(t("labels").where("doc_id % 50 = 0")).withColumn("split", F.when(col("doc_id") % 9 == 0, "test").otherwise("train"))
    return G.training_checks(x, "doc_id", ("toxic",), "split")


# ---------------------------------------------------------------- systems, runs, clusters
@query(f"""with e as (select event_type, user_id % 4 as system, value >= 50 as a, value is not null as checked from events), x as (select case when grouping(event_type) = 1 then 'all' else event_type end as source, system, count(*)::double as n, count(*) filter (where a)::double as a from e where checked group by grouping sets ((system), (event_type, system)))
select source, system, n::bigint as n, a::bigint as hits, round(a / n, 6) as rate, {WILSON.format(s='-1 *')} as low, {WILSON.format(s='')} as high from x""")
def l14_rates_by_system(t):
    e = t("events").where("value is not null").select("event_type", (col("user_id") % 4).alias("system"), (col("value") >= 50).alias("a"))
    return K.system_rates(e, "event_type", "system", col("a"))


@query("""with a as (select event_type, round(avg(value), 4) as v from events where event_id % 2 = 0 group by 1), b as (select event_type, round(avg(value), 4) as v from events where event_id % 2 = 1 and event_type <> 'error' group by 1)
select event_type, a.v as now, b.v as before, round(a.v - b.v, 4) as change, case when b.v is null then 'new' when abs(a.v - b.v) <= 1.0 then 'steady' else 'changed' end as state from a left join b using (event_type)""")
def l19_compare_runs(t):
    run = lambda rows: rows.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("v"))
    e = t("events")
    return K.compare_runs(run(e.where("event_id % 2 = 0")), run(e.where("event_id % 2 = 1 and event_type <> 'error'")), ["event_type"], "v", 1.0)


@query("""with g as (select doc_id, source as stratum, lang as grp, doc_id % 3 = 0 as test from documents), n as (select stratum, grp, count(*) as g from g where test group by all), s as (select stratum, count(*) as s from g group by 1)
select doc_id, case when n.g > greatest(s * 0.02, 3.0) then 'r:' || doc_id else g.grp end as cluster from g join n on g.stratum = n.stratum and g.grp is not distinct from n.grp join s on g.stratum = s.stratum where test""")
def l21_clusters(t):
    d = t("documents").select("doc_id", col("source").alias("stratum"), col("lang").alias("grp"), (col("doc_id") % 3 == 0).alias("test"))
    sizes = d.groupBy("stratum").agg(F.count("*").alias("n"))
    return C.clusters(d.where("test"), sizes, "stratum", "grp", "doc_id", least=3).select("doc_id", col("grp").alias("cluster"))


@query("""with s as (select event_id, user_id, event_type = 'error' as y, value >= 50 as a, user_id % 2 = 0 as b from events), n as (select count(*) filter (where y and a) as tpa, count(*) filter (where y and b) as tpb, count(*) filter (where y) as pos, count(*) filter (where not y and a) as fpa, count(*) filter (where not y and b) as fpb, count(*) filter (where not y) as neg from s)
select 'recall' as statistic, round(tpb / pos - tpa / pos, 6) as value from n union all select 'false alarms', round(fpb / neg - fpa / neg, 6) from n""")
def l8_l26_paired_differences(t):
    e = t("events").select("user_id", (col("event_type") == "error").alias("y"), (col("value") >= 50).alias("a"), (col("user_id") % 2 == 0).alias("b"))
    return K.paired_differences(e, "user_id", col("y"), col("a"), col("b")).select("statistic", F.round("value", 6).alias("value"))


@query()
def l8_paired_intervals(t):
    e = t("events").select("user_id", (col("event_type") == "error").alias("y"), (col("value") >= 50).alias("a"), (col("user_id") % 2 == 0).alias("b"))
    return K.paired_differences(e, "user_id", col("y"), col("a"), col("b"))
