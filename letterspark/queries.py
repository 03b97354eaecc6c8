"""Registry of the operator queries: Spark callables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterspark.functions import text as T
from letterspark.operators import evaluate as L
from letterspark.operators import lexicon as P
from letterspark.operators import scoring as K
from letterspark.operators import splits as C
from letterspark.operators import staging as B
from letterspark.plans.fixtures import view, with_views
from letterspark.plans.shared import cut
from letterspark.streaming import jobs as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Frames = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers a function of ``frames`` (name of a table or view to DataFrame), with its SQL."""

    def add(f: Callable[[Frames], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: view(spark, sf_dir, name) if name.startswith("fx_") else spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


col = F.col
FP = r"nullif(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g'), '')"


def _order():
    """Rows with full headers first, then by source and id."""
    return [~col("has_full_headers"), col("source"), col("doc_id")]


RANKED = f"ranked as (select *, row_number() over (partition by fp order by has_full_headers desc, source, doc_id) as rn from (select *, sha256({FP}) as fp from fx_docs) where fp is not null)"
POS = "(('0x' || substr(sha256('1|' || {}::varchar), 1, 15))::bigint / 1152921504606846976.0)"
MOD100 = "list_reduce(list_prepend(0, list_transform(string_split(sha256({}::varchar), ''), lambda d: ('0x' || d)::int)), lambda acc, d: (acc * 16 + d) % {})"
# ---------------------------------------------------------------- staging


@query(f"select doc_id, sha256({FP}) as fp, substr(sha256(doc_id::varchar), 1, 16) as row_id from fx_docs")
def b1_b2_fingerprint(t):
    return t("fx_docs").select("doc_id", B.fingerprint(col("text")).alias("fp"), B.row_id(col("doc_id")).alias("row_id"))


@query(f"select source, count(*) as n_rows, count(*) filter (where {FP} is null) as n_dropped from fx_docs group by source")
def b3_unreadable(t):
    return B.unreadable_counts(t("fx_docs"))


@query(f"with {RANKED} select doc_id, source, category, fp from ranked where rn = 1")
def b4_deduplicate(t):
    return B.deduplicate(t("fx_docs"), _order()).select("doc_id", "source", "category", "fp")


@query(f"with {RANKED} select r.source as removed_source, k.source as kept_source, count(*) as n from ranked r join ranked k on r.fp = k.fp and k.rn = 1 where r.rn > 1 group by all")
def b5_removed_pairs(t):
    return B.removed_pairs(t("fx_docs"), _order())


@query(f"with {RANKED} select categories, count(*) as n_groups from (select fp, string_agg(distinct category, '/' order by category) as categories from ranked group by fp having count(distinct category) > 1) group by 1")
def b6_category_conflicts(t):
    return B.category_conflicts(t("fx_docs"))


@query("select doc_id, category in ('phishing', 'fraud') as is_attack from fx_docs")
def b7_attack_flag(t):
    return B.with_attack_flag(t("fx_docs")).select("doc_id", "is_attack")


@query("select l_orderkey, count(*) as n from lineitem group by 1 having count(*) > 1")
def b8_repeated_keys(t):
    return B.repeated_keys(t("lineitem"), "l_orderkey")


@query("select case when grouping(source) = 1 then 'all' else source end as source, case when grouping(category) = 1 then 'all' else category end as category, count(*) as n from fx_docs group by cube (source, category)")
def b9_crosstab(t):
    return B.crosstab(t("fx_docs"), "source", "category")


@query("""with e as (select *, date_trunc('hour', ts) as second, case when user_id % 5 <> 0 then user_id end as sender from events)
select event_id from (select *, row_number() over (partition by second, sender, event_type order by event_id) as rn from e where second is not null and sender is not null and event_type is not null) where rn = 1
union all select event_id from e where second is null or sender is null or event_type is null""")
def b10_message_copies(t):
    e = t("events").select("event_id", "event_type", F.date_trunc("hour", "ts").alias("second"), F.when(col("user_id") % 5 != 0, col("user_id")).alias("sender"))
    return B.drop_message_copies(e, ["second", "sender", "event_type"], [col("event_id")]).select("event_id")


# ---------------------------------------------------------------- splits
SUBJECT = r"trim(regexp_replace(regexp_extract(raw_headers, '(?i)(?:^|\n)Subject:([^\n]*(?:\n[ \t][^\n]*)*)', 1), '[ \t\r\n]+', ' ', 'g'))"
TKEY = rf"regexp_replace(regexp_replace(lower({SUBJECT}), '^[ ]*(?:(?:re|fw|fwd|aw|sv|antw)[ ]*(?:\[[0-9]+\])?[ ]*:[ ]*)+', ''), '[^\p{{L}}\p{{N}}]+', '', 'g')"
GROUPS = f"grouped as (select id, source as stratum, case when {TKEY} <> '' then 't:' || {TKEY} else 'r:' || id::varchar end as grp from fx_headers)"
BROKEN = """sized as (select *, count(*) over (partition by stratum, grp) as g, count(*) over (partition by stratum) as s from grouped),
broken as (select id, stratum, case when g > greatest(s * 0.02, 25.0) then 'r:' || id::varchar else grp end as grp from sized)"""
SPLIT = f"""sizes as (select stratum, grp, count(*) as n, {POS.format("grp")} as pos from broken group by stratum, grp),
done as (select *, coalesce(sum(n) over (partition by stratum order by pos, grp rows between unbounded preceding and 1 preceding), 0) as done, sum(n) over (partition by stratum) as total from sizes),
split as (select stratum, grp, case when 10 * (2 * done + n) < 14 * total then 'train' when 10 * (2 * done + n) < 17 * total then 'validation' else 'test' end as split from done)"""


def _grouped(t):
    h = t("fx_headers")
    return cut(h.select("id", col("source").alias("stratum"), C.group_key(C.subject_of(col("raw_headers")), col("id")).alias("grp")))


def _split(t):
    return C.assign_splits(C.break_up_groups(_grouped(t), "stratum", "grp", "id"), "stratum", "grp")


@query(f"with {GROUPS} select id, {SUBJECT} as subject, grp from fx_headers join grouped using (id)")
def c1_c3_group_keys(t):
    h = t("fx_headers").withColumn("subject", C.subject_of(col("raw_headers")))
    return h.select("id", "subject", C.group_key(col("subject"), col("id")).alias("grp"))


@query(f"with {GROUPS}, {BROKEN} select id, grp from broken")
def c4_break_up_groups(t):
    return C.break_up_groups(_grouped(t), "stratum", "grp", "id").select("id", "grp")


@query(f"select doc_id, {POS.format('doc_id')} as position from documents")
def c5_position(t):
    return t("documents").select("doc_id", C.position(col("doc_id")).alias("position"))


@query(f"with {GROUPS}, {BROKEN}, {SPLIT} select id, split from broken join split using (stratum, grp)")
def c6_assign_splits(t):
    return _split(t).select("id", "split")


@query(f"with {GROUPS}, {BROKEN}, {SPLIT} select grp, count(distinct split) as n from broken join split using (stratum, grp) group by 1 having count(distinct split) > 1")
def c7_straddling_groups(t):
    return C.straddling_groups(_split(t), "grp")


@query(f"with {GROUPS}, {BROKEN}, {SPLIT} select stratum, split, count(*) as n, round(count(*) / sum(count(*)) over (partition by stratum), 4) as share from broken join split using (stratum, grp) group by stratum, split")
def c8_split_report(t):
    return C.split_report(_split(t), "stratum")


QUOTA = "quota as (select * from (values ('en', 40), ('de', 10), ('fr', 1000000)) as q(lang, n))"


def _quota(t):
    return t("documents").sparkSession.createDataFrame([("en", 40), ("de", 10), ("fr", 1000000)], "lang string, n long")


@query(f"with {QUOTA}, r as (select doc_id, lang, row_number() over (partition by lang order by {POS.format('doc_id')}, doc_id) as rn from documents) select doc_id, lang from r join quota using (lang) where rn <= n")
def c9_stratified_draw(t):
    return C.draw(t("documents").select("doc_id", "lang"), ["lang"], _quota(t), "doc_id").select("doc_id", "lang")


@query(f"with {QUOTA}, h as (select lang, count(*) as c from documents group by 1) select lang, n, coalesce(c, 0) as eligible, greatest(0, n - coalesce(c, 0)) as short from quota left join h using (lang)")
def c9_shortages(t):
    return C.shortages(t("documents"), ["lang"], _quota(t))


@query("select doc_id, source from (select doc_id, source, row_number() over (partition by source order by sha256('1|' || doc_id::varchar)) as rn from documents) where rn <= 7")
def c10_capped_draw(t):
    return C.capped_draw(t("documents").select("doc_id", "source"), "source", 7, "doc_id")


@query("select source, n as size, least(n, 60, greatest(5, round_even(500 * n / sum(n) over (), 0)))::bigint as quota from (select source, count(*) as n from documents group by 1)")
def c11_proportional_quota(t):
    return C.proportional_quota(t("documents"), "source", 500, 5, 60)


@query(f"select doc_id, 'b' || lpad((r // 50 + 1)::varchar, 4, '0') as batch, r % 50 + 1 as local_id from (select doc_id, row_number() over (order by {POS.format('doc_id')}, doc_id) - 1 as r from documents)")
def c12_batches(t):
    return C.assign_batches(t("documents").select("doc_id"), "doc_id", 50)


@query(f"select doc_id, {MOD100.format('doc_id', 100)} as bucket from documents")
def c13_modulo_bucket(t):
    return t("documents").select("doc_id", C.modulo_bucket(col("doc_id")).alias("bucket"))


@query("select doc_id, (['wire', 'gift', 'bank'])[" + MOD100.format("('plan|' || doc_id::varchar)", 3) + " + 1] as choice from documents")
def c14_pick(t):
    return t("documents").select("doc_id", C.pick("plan", col("doc_id"), ["wire", "gift", "bank"]).alias("choice"))


@query("select doc_id from documents order by sha256('1|' || doc_id::varchar) limit 100")
def c15_seeded_limit(t):
    return C.seeded_limit(t("documents").select("doc_id"), "doc_id", 100)


# ---------------------------------------------------------------- lexicon
INVISIBLE = T.INVISIBLE
GLUED = r"""regexp_replace(regexp_replace(translate(lower(text), '‘’‛ʼ´`' || '{inv}', repeat('''', 6)), '\[(url|email|file|domain)\]', ' plh\1 ', 'g'), '([a-z]) '' (t|s|re|ve|ll|d|m)([^a-z0-9]|$)', '\1''\2\3', 'g')""".replace("{inv}", INVISIBLE)
NORM = rf"""trim(regexp_replace(regexp_replace(regexp_replace({GLUED}, '([a-z])''([a-z])', '\1\2', 'g'), '([a-z])''([a-z])', '\1\2', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"""
HITS = f"""words as (select doc_id, string_split({NORM}, ' ') as w from documents),
place as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words),
hits as (select doc_id, tactic, phrase, weight, i - 1 as start, len(string_split(phrase, ' ')) as size from place join fx_lexicon on w[i] = split_part(phrase, ' ', 1) and array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase)"""


ODD = "concat(text, case doc_id % 3 when 0 then concat(' don’t kee​p [URL] we ', chr(39), ' ll rock', chr(39), 'n', chr(39), 'roll') when 1 then concat(' it ', chr(39), ' s so', '­', 'ft_x') else '' end)"


@query(f"with odd as (select doc_id, {ODD} as text from documents) select doc_id, {NORM} as text from odd")
def f1_normalise(t):
    return t("documents").select("doc_id", F.expr(ODD).alias("text")).select("doc_id", T.normalise(col("text")).alias("text"))


TACTICS = ("t1", "t2", "t3", "t4")
BAD_LEXICON = "lex as (select tactic, phrase, strength from fx_lexicon union all select * from (values ('t9', 'x', 'weak'), ('t1', 'The', 'weak'), ('t2', '!!', 'weak'), ('t2', 'a b c d e f g h i j k l m', 'strong'), ('t3', 'ok', 'loud')) as v(tactic, phrase, strength))"


@query(f"""with {BAD_LEXICON}, n as (select *, {NORM.replace('(text)', '(phrase)')} as n from lex), s as (select *, len(list_filter(string_split(n, ' '), lambda w: w <> '')) as size from n)
select tactic, phrase, case when tactic not in ('t1', 't2', 't3', 't4') then 'unknown tactic' when strength not in ('strong', 'weak') then 'bad strength' when size = 0 then 'empty' else 'too long' end as problem from s where tactic not in ('t1', 't2', 't3', 't4') or strength not in ('strong', 'weak') or size = 0 or size > 12
union all select tactic, min(phrase), 'duplicate' from s where size > 0 group by tactic, n having count(*) > 1 union all select x, null, 'no phrases' from (values ('t1'), ('t2'), ('t3'), ('t4')) as v(x) where x not in (select tactic from lex)""")
def f2_lexicon_problems(t):
    lex = t("fx_lexicon").select("tactic", "phrase", "strength")
    more = [("t9", "x", "weak"), ("t1", "The", "weak"), ("t2", "!!", "weak"), ("t2", "a b c d e f g h i j k l m", "strong"), ("t3", "ok", "loud")]
    return P.lexicon_problems(lex.unionByName(lex.sparkSession.createDataFrame(more, "tactic string, phrase string, strength string")), TACTICS)


@query(f"with {HITS} select doc_id, tactic, phrase, count(*) as n from hits group by all")
def f3_phrase_hits(t):
    return P.phrase_hits(t("documents"), t("fx_lexicon")).groupBy("doc_id", "tactic", "phrase").agg(F.count("*").alias("n"))


SPANS = f"""{HITS}, m as (select *, row_number() over (partition by doc_id, tactic order by size desc, start, phrase) as rn from hits),
fold as (select doc_id, tactic, 0::bigint as rn, []::struct(a int, b int)[] as used, []::varchar[] as seen, 0.0::double as score from (select distinct doc_id, tactic from hits)
  union all select f.doc_id, f.tactic, m.rn, case when t.taken or m.size = 1 then used else list_append(used, {{'a': m.start::int, 'b': (m.start + m.size)::int}}) end,
    case when t.taken or list_contains(seen, m.phrase) then seen else list_append(seen, m.phrase) end, case when t.taken or list_contains(seen, m.phrase) then score else score + m.weight end
  from fold f join m on f.doc_id = m.doc_id and f.tactic = m.tactic and m.rn = f.rn + 1, lateral (select len(list_filter(f.used, lambda u: m.start < u.b and m.start + m.size > u.a)) > 0 as taken) t),
scores as (select doc_id, tactic, arg_max(score, rn) as score from fold group by 1, 2)"""


@query(f"with recursive {SPANS} select doc_id, tactic, score, score >= case tactic when 't1' then 1.5 when 't2' then 0.5 else 1.0 end as fired from scores")
def f4_f5_tactic_scores(t):
    return P.fired(P.tactic_scores(P.phrase_hits(t("documents"), t("fx_lexicon"))), {"t1": 1.5, "t2": 0.5})


@query(f"""with recursive {SPANS}, x as (select t.tactic, d.doc_id, d.category, d.source, coalesce(score, 0) as s from fx_docs d cross join (select distinct tactic from scores) t left join scores on d.doc_id = scores.doc_id and t.tactic = scores.tactic)
select tactic, case when grouping(category) = 1 and grouping(source) = 1 then 'all' when grouping(source) = 1 then 'category:' || category else 'source:' || source end as scope, count(*) as n, count(*) filter (where s >= 1) as fired, count(*) filter (where s > 0) as any_hit, round(avg(s), 6) as mean_score
from x group by grouping sets ((tactic), (tactic, category), (tactic, source))""")
def f6_hit_rates(t):
    docs = t("fx_docs")
    return P.hit_rates(docs, P.tactic_scores(P.phrase_hits(docs, t("fx_lexicon"))))


@query(f"""with {HITS}, d as (select doc_id, category in ('phishing', 'fraud', 'spam') as attack from fx_docs), z as (select count(*) filter (where attack) as na, count(*) filter (where not attack) as nh from d),
n as (select tactic, count(distinct case when attack then doc_id end) as a, count(distinct case when not attack then doc_id end) as h from hits join d using (doc_id) group by 1),
r as (select l.tactic, coalesce(a, 0) / nullif(na, 0) as ra, coalesce(h, 0) / nullif(nh, 0) as rh from (select distinct tactic from fx_lexicon) l left join n on l.tactic = n.tactic cross join z),
p as (select tactic, phrase, count(distinct doc_id) as c from hits group by all), top_ as (select tactic, max(round(c / s, 6)) as v from (select *, sum(c) over (partition by tactic) as s from p) group by 1)
select 'attack ratio' as "check", tactic, round(ra / nullif(rh, 0), 6) as value, case when ra > 0 and ra >= 1.5 * rh then 'PASS' else 'FAIL' end as status from r
union all select 'coverage', tactic, round(ra, 6), case when ra >= 0.01 then 'PASS' else 'FAIL' end from r union all select 'dominant phrase', l.tactic, v, case when v <= 0.6 then 'PASS' else 'FAIL' end from (select distinct tactic from fx_lexicon) l left join top_ on l.tactic = top_.tactic""")
def f8_sanity_checks(t):
    docs = t("fx_docs")
    return P.sanity_checks(t("fx_lexicon"), P.phrase_hits(docs, t("fx_lexicon")), docs)


@query(f"with {HITS}, n as (select tactic, phrase, count(distinct doc_id) as documents from hits group by all), j as (select x.tactic, x.phrase, x.strength, coalesce(n.documents, 0) as documents from fx_lexicon x left join n on x.tactic = n.tactic and x.phrase = n.phrase) select *, case when sum(documents) over (partition by tactic) > 0 then round(documents / sum(documents) over (partition by tactic), 6) end as share from j")
def f7_phrase_table(t):
    return P.phrase_table(t("fx_lexicon"), P.phrase_hits(t("documents"), t("fx_lexicon")))


# ---------------------------------------------------------------- labels
@query("""with n as (select label, count(*) as n, sum(a1) as pos_a, sum(a2) as pos_b, sum((a1 = a2)::int) as same, sum((a1 = 1 and a2 = 1)::int) as both_ from fx_votes where a1 is not null and a2 is not null group by label),
p as (select *, same / n as po, (pos_a * pos_b + (n - pos_a) * (n - pos_b)) / (n * n)::double as pe from n), k as (select *, case when pe < 1 then round((po - pe) / (1 - pe), 6) end as kappa from p)
select label, n, pos_a, pos_b, both_ as "both", round(po, 6) as agreement, kappa, case when kappa is null then null when kappa < 0.2 then 'slight' when kappa < 0.4 then 'fair' when kappa < 0.6 then 'moderate' when kappa < 0.8 then 'substantial' else 'almost perfect' end as reading from k""")
def g6_g7_kappa(t):
    return L.kappa(t("fx_votes"), "label", "a1", "a2")


@query("select doc_id, label from fx_votes where a1 <> a2 and doc_id % 3 <> 0")
def g9_disagreements(t):
    v = t("fx_votes")
    return L.disagreements(v, v.where("doc_id % 3 = 0").select("doc_id", "label"))


@query("select doc_id, label, case when a1 = a2 then a1 else tie end as value, case when a1 = a2 then 'agreed' when tie is not null then 'tie-breaker' else 'pending' end as label_source from fx_votes")
def g10_majority(t):
    return L.majority(t("fx_votes"))


# ---------------------------------------------------------------- ledger, score
PTS = "case severity when 'high' then 60.0 when 'medium' then 35.0 when 'low' then 5.0 else 0.0 end"
SCORED = f"""groups_ as (select msg_id, claim_id, claim_type, max({PTS}) as p from fx_ledger where contradiction group by all having max({PTS}) > 0),
raw as (select msg_id, sum(round(p * pow(0.5, k), 2)) as raw from (select msg_id, p, row_number() over (partition by msg_id order by p desc, claim_id, claim_type) - 1 as k from groups_) group by 1),
scored as (select msg_id, least(100, floor(coalesce(raw, 0) + 0.5))::int as score from (select distinct msg_id from fx_ledger) left join raw using (msg_id)),
banded as (select *, case when score >= 70 then 'high' when score >= 35 then 'medium' else 'low' end as band from scored)"""


@query("select msg_id, claim_id, case severity when 'low' then 'medium' when 'medium' then 'high' else severity end as up, case severity when 'high' then 'medium' when 'medium' then 'low' else severity end as down from fx_ledger")
def i12_severity_shift(t):
    s = col("severity")
    return t("fx_ledger").select("msg_id", "claim_id", K.shift(s, F.lit(1)).alias("up"), K.shift(s, F.lit(-1)).alias("down"))


@query("select msg_id, claim_id, verifier, count(*) as n from fx_ledger group by all having count(*) > 1")
def i14_repeated_verdicts(t):
    return B.repeated_keys(t("fx_ledger"), "msg_id", "claim_id", "verifier")


@query("""select case when grouping(claim_type) = 1 then 'any' else claim_type end as claim_type, case when grouping(verifier) = 1 then 'any' else verifier end as verifier, count(distinct msg_id) as messages,
count(*) filter (where contradiction) as contradictions, count(*) filter (where not contradiction) as consistent, count(*) filter (where contradiction is null) as not_checkable from fx_ledger group by cube (claim_type, verifier)""")
def i15_verdict_rates(t):
    return K.verdict_rates(t("fx_ledger"))


@query("""with rules as (select v.verifier, 'r' || r as rule from (values ('header'), ('request')) as v(verifier) cross join range(0, 12) as x(r)), n as (select verifier, rule, count(*) as n_rows, count(*) filter (where contradiction) as contradictions from fx_ledger group by all),
j as (select verifier, rule, coalesce(n_rows, 0) as n_rows, coalesce(contradictions, 0) as contradictions from rules left join n using (verifier, rule)) select *, case when sum(n_rows) over (partition by verifier) > 0 then round(n_rows / sum(n_rows) over (partition by verifier), 6) end as share from j""")
def i16_rule_table(t):
    ledger = t("fx_ledger")
    rules = ledger.sparkSession.createDataFrame([(v, f"r{k}") for v in ("header", "request") for k in range(12)], "verifier string, rule string")
    return K.rule_table(ledger, rules)


@query("select * from (select claim_type, rule, count(*) as n, row_number() over (partition by claim_type order by count(*) desc, rule) as rank from fx_ledger where contradiction is null group by 1, 2) where rank <= 3")
def i18_top_reasons(t):
    return K.top_reasons(t("fx_ledger"))


FACTOR = "case rule when 'r0' then 0.0 when 'r4' then 0.5 else 1.0 end"
FIRED = "fired as (select o_orderkey as msg_id, unnest(list_filter([case when o_orderkey % 5 = 0 then 'urgency' end, case when o_orderkey % 7 = 0 then 'secrecy' end, case when o_orderkey % 2 = 0 then 'authority' end, case when o_orderkey % 3 = 0 then 'scarcity' end, 'other'], lambda x: x is not null)) as tactic from orders)"
ACTION = "case band " + " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in K.ACTIONS.items()) + " end || case when band = 'low' then '' else coalesce(case top " + " ".join(f"when '{k}' then ' {v}'" for k, v in K.ADDENDA.items()) + " end, '') end"


@query(f"""with groups_ as (select msg_id, claim_id, claim_type, max({PTS} * {FACTOR}) as p from fx_ledger where contradiction group by all having max({PTS} * {FACTOR}) > 0),
k as (select *, row_number() over (partition by msg_id order by p desc, claim_id, claim_type) - 1 as k from groups_), raw as (select msg_id, sum(round(p * pow(0.5, k), 2)) as raw, arg_min(claim_type, k) as top from k group by 1), {FIRED},
f as (select msg_id, 1 + 0.25 * count(*) filter (where tactic in ('urgency', 'secrecy')) as m, least(12, 4 * count(*) filter (where tactic <> 'other')) as x from fired group by 1),
scored as (select l.msg_id, least(100, floor(coalesce(raw, 0) * coalesce(m, 1) + coalesce(x, 0) + 0.5))::int as score, top from (select distinct msg_id from fx_ledger) l left join raw on l.msg_id = raw.msg_id left join f on l.msg_id = f.msg_id),
b as (select *, case when score >= 70 then 'high' when score >= 35 then 'medium' else 'low' end as band from scored)
select msg_id, score, band, {ACTION} as action from b""")
def k1_k3_score(t):
    ledger = t("fx_ledger")
    factors = ledger.sparkSession.createDataFrame([("r0", 0.0), ("r4", 0.5)], "rule string, factor double")
    k = col("o_orderkey")
    names = F.array_compact(F.array(*(F.when(k % m == 0, n) for n, m in (("urgency", 5), ("secrecy", 7), ("authority", 2), ("scarcity", 3))), F.lit("other")))
    return K.score(ledger, factors, fired=t("orders").select(k.alias("msg_id"), F.explode(names).alias("tactic"))).drop("top_rule")


@query(f"with {SCORED} select o_orderpriority as source, band, count(*) as n, round(avg(score), 6) as mean_score from banded join orders on msg_id = o_orderkey group by all")
def k2_bands_by_source(t):
    s = K.score(t("fx_ledger")).join(t("orders").select(col("o_orderkey").alias("msg_id"), col("o_orderpriority").alias("source")), "msg_id")
    return s.groupBy("source", "band").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("""with c as (select msg_id, claim_id, claim_type, bool_or(contradiction) as any_, count(contradiction) as known from fx_ledger group by all)
select msg_id, count(*) as found, count(*) filter (where known > 0) as checked, count(*) filter (where any_) as contradicted, count(*) filter (where not any_) as consistent, count(*) filter (where known = 0) as not_checkable from c group by 1""")
def k5_coverage(t):
    return K.coverage(t("fx_ledger"))


WILSON = "round((a / n + {s} 1.959963984540054 * sqrt((a / n) * (1 - a / n) / n + 1.959963984540054 * 1.959963984540054 / (4 * n * n)) + 1.959963984540054 * 1.959963984540054 / (2 * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n), 6)"


ORDINARY = "ordinary as (select o_orderkey as msg_id, o_orderpriority as source from orders where o_orderstatus = 'F')"


def _ordinary(t):
    return t("orders").where("o_orderstatus = 'F'").select(col("o_orderkey").alias("msg_id"), col("o_orderpriority").alias("source"))


@query(f"""with {ORDINARY}, j as (select l.*, o.source from fx_ledger l join ordinary o using (msg_id)), n as (select source, count(distinct msg_id) as n from j where contradiction is not null group by 1),
h as (select rule, source, count(distinct msg_id) as hits from j where contradiction group by all), r as (select x.rule, n.source, coalesce(hits, 0) as hits, n from (select distinct rule from fx_ledger) x cross join n left join h on x.rule = h.rule and n.source = h.source),
w as (select *, hits >= 5 as judged, max(case when hits >= 5 then hits / n end) over (partition by rule) as worst from r)
select rule, source, hits, n, judged, case when worst > 0.2 then 0.0 when worst > 0.17 then 0.5 else 1.0 end as factor from w""")
def k9_reliability(t):
    return K.reliability(t("fx_ledger"), _ordinary(t), "source", judged=5, half=0.17, zero=0.2)


TOP = f"""tops as (select msg_id, arg_min(rule, k) as top_rule from (select msg_id, rule, row_number() over (partition by msg_id order by p desc, claim_id, claim_type) as k from (select msg_id, claim_id, claim_type, max({PTS}) as p, arg_min(rule, struct_pack(a := -({PTS}), b := rule)) as rule from fx_ledger where contradiction group by all having max({PTS}) > 0)) group by 1)"""


@query(f"""with {SCORED}, {TOP}, s as (select b.*, o_orderpriority as source, top_rule from banded b join orders on b.msg_id = o_orderkey left join tops t on b.msg_id = t.msg_id),
g as (select source, count(*)::double as n, count(*) filter (where band = 'high')::double as h, count(*) filter (where band <> 'low')::double as a from s group by 1),
r as (select source, top_rule, count(*) as c, row_number() over (partition by source order by count(*) desc, top_rule) as k from s where band <> 'low' group by source, top_rule), t as (select source, string_agg(top_rule || ':' || c, '; ' order by k) as top_rules from r where k <= 4 group by 1)
select g.source, n::bigint as n, h::bigint as high, a::bigint as alarms, top_rules, {WILSON.replace('a / n', 'h / n').format(s='-1 *')} as high_low, {WILSON.replace('a / n', 'h / n').format(s='')} as high_high, {WILSON.format(s='-1 *')} as alarms_low, {WILSON.format(s='')} as alarms_high,
case when n < 20 then 'info' when h / n > 0.01 or a / n > 0.05 then 'OVER' else 'PASS' end as verdict from g left join t on g.source = t.source""")
def k10_budget(t):
    s = K.score(t("fx_ledger")).join(t("orders").select(col("o_orderkey").alias("msg_id"), col("o_orderpriority").alias("source")), "msg_id")
    return K.budget(s, "source")


@query(f"""with {FIRED}, {ORDINARY}, c as (select msg_id, claim_id, claim_type, max(case severity when 'high' then 3 when 'medium' then 2 else 1 end) as r from fx_ledger where contradiction group by all),
f as (select msg_id, count(*) filter (where tactic in ('urgency', 'secrecy')) as pressure, least(12, 4 * count(*) filter (where tactic <> 'other')) as extra from fired group by 1),
k as (select *, row_number() over (partition by msg_id order by r desc) - 1 as k from c), u as (select distinct msg_id, source from fx_ledger join ordinary using (msg_id) where contradiction is not null),
grid as (select h::double as h, m::double as m, p::double as p from (values (50), (60), (70)) as a(h) cross join (values (25), (35), (45)) as b(m) cross join (values (0.15), (0.25), (0.35)) as c(p)),
s as (select g.*, u.msg_id, u.source, least(100, floor(coalesce(sum(round(case r when 3 then h when 2 then m when 1 then 5.0 end * pow(0.5, k), 2)), 0) * (1 + p * coalesce(any_value(pressure), 0)) + coalesce(any_value(extra), 0) + 0.5)) as s from u cross join grid g left join k on u.msg_id = k.msg_id left join f on u.msg_id = f.msg_id group by g.h, g.m, g.p, u.msg_id, u.source),
b as (select h, m, p, source, count(*) as n, count(*) filter (where s >= 70) as high, count(*) filter (where s >= 35) as alarms from s group by all having count(*) >= 20),
o as (select h, m, p, count(*) as groups, count(*) filter (where high / n > 0.3 or alarms / n > 0.75) as over_, round(max(high / n), 6) as worst_high, round(max(alarms / n), 6) as worst_alarms from b group by all),
d as (select *, m between 35 and 69 and h between 35 and 69 and m < h and h * (1 + p) + 4 >= 70 as meaning, round(abs(h - 60) / 10 + abs(m - 35) / 10 + abs(p - 0.25) / 0.1, 2) as distance from o),
z as (select *, row_number() over (order by not (meaning and over_ = 0), distance, h, m, p) as rn, bool_or(meaning and over_ = 0) over () as some_ from d)
select h as high_points, m as medium_points, p as step, groups, over_ as "over", worst_high, worst_alarms, meaning, distance, case when some_ then rn = 1 else h = 60 and m = 35 and p = 0.25 end as chosen from z""")
def k11_rescore_grid(t):
    k = col("o_orderkey")
    names = F.array_compact(F.array(*(F.when(k % m == 0, n) for n, m in (("urgency", 5), ("secrecy", 7), ("authority", 2), ("scarcity", 3))), F.lit("other")))
    fired = t("orders").select(k.alias("msg_id"), F.explode(names).alias("tactic"))
    return K.calibrate(t("fx_ledger"), _ordinary(t), "source", fired, high_budget=0.3, medium_budget=0.75)


# ---------------------------------------------------------------- evaluation
CONF = "count(*) filter (where y and p) as tp, count(*) filter (where not y and p) as fp, count(*) filter (where y and not p) as fn, count(*) filter (where not y and not p) as tn"
RATES = "case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0 end as precision, case when tp + fn > 0 then round(tp / (tp + fn), 6) else 0 end as recall, case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn), 6) else 0 end as f1"


def _scores(t):
    return t("events").select("event_id", "event_type", col("user_id").alias("cluster"), (col("event_type") == "error").alias("y"), (col("value") >= 50).alias("p"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(col("value") / 100, 2))).alias("s"))


@query(f"with x as (select user_id % 5 as g, event_type = 'error' as y, value >= 50 as p from events), n as (select g, {CONF} from x group by g) select *, {RATES} from n")
def l1_confusion(t):
    return L.confusion(_scores(t).withColumn("g", col("cluster") % 5), ["g"], col("y"), col("p"))


@query(f"with x as (select user_id % 5 as g, event_type = 'error' as y, value >= 50 as p from events), n as (select g, {CONF} from x group by g), r as (select *, {RATES} from n) select g % 2 as half, round(avg(f1), 6) as macro_f1 from r group by 1")
def l2_macro_f1(t):
    c = L.confusion(_scores(t).withColumn("g", col("cluster") % 5), ["g"], col("y"), col("p"))
    return L.macro_f1(c.withColumn("half", col("g") % 2), ["half"])


@query("""with x as (select user_id % 5 as g, event_type = 'error' as y, least(1.0, greatest(0.0, round(value / 100, 2))) as s from events), k as (select unnest(range(1, 20)) as k),
n as (select g, k, count(*) filter (where y and floor(round(s * 20, 6)) >= k) as tp, count(*) filter (where not y and floor(round(s * 20, 6)) >= k) as fp, count(*) filter (where y and floor(round(s * 20, 6)) < k) as fn from x cross join k group by 1, 2),
f as (select *, case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn), 6) else 0 end as f1 from n)
select g, round(k / 20, 2) as threshold, f1 from (select *, row_number() over (partition by g order by f1 desc, abs(k - 10), k) as rn from f) where rn = 1""")
def l3_tune_threshold(t):
    return L.tune_threshold(_scores(t).withColumn("g", col("cluster") % 5), "g", col("s"), col("y"))


@query("""with n as (select 1 as g, score, sum(label) as p, sum(1 - label) as q from fx_scores group by score), b as (select *, coalesce(sum(q) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from n)
select g, round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) as auc from b group by g""")
def l6_auc(t):
    return L.weighted_auc(t("fx_scores").withColumn("g", F.lit(1)), "g", "score", col("label") == 1)


@query("select score as cut from (select score, row_number() over (order by score desc) as rn, count(*) over () as n from fx_scores where label = 0) where rn = floor(n * 0.05) + 1")
def l7_matched_cut(t):
    return L.matched_cut(t("fx_scores"), "score", col("label") == 1, 0.05)


@query()
def l5_bootstrap(t):
    s = {"hit": F.sum("label"), "n": F.count("*")}
    return L.bootstrap(t("fx_scores"), "cluster", s, col("hit") / col("n"))


@query("""with x as (select distinct user_id, event_type as label from events), s as (select label, count(*) as n from x group by 1)
select a.label as a, b.label as b, count(*) as "both", round(count(*) / (any_value(sa.n) + any_value(sb.n) - count(*)), 6) as jaccard from x a join x b on a.user_id = b.user_id and a.label < b.label join s sa on sa.label = a.label join s sb on sb.label = b.label group by 1, 2""")
def l9_cooccurrence(t):
    return L.cooccurrence(t("events").select("user_id", col("event_type").alias("label")), "user_id", "label")


@query("select event_type, count(*) filter (where a and b) as \"both\", count(*) filter (where a and not b) as only_a, count(*) filter (where not a and b) as only_b, count(*) filter (where not a and not b) as neither from (select event_type, value >= 50 as a, user_id % 2 = 0 as b from events) group by 1")
def l15_detector_agreement(t):
    return L.detector_agreement(_scores(t), ["event_type"], col("p"), col("cluster") % 2 == 0)


@query("select 'documents have ids' as \"check\", count(*) filter (where doc_id is null) as value, 0::bigint as expected, case when count(*) filter (where doc_id is null) = 0 then 'PASS' else 'FAIL' end as status from documents union all select 'no repeated ids', count(*) - count(distinct doc_id), 0, case when count(*) = count(distinct doc_id) then 'PASS' else 'FAIL' end from documents")
def l20_check_table(t):
    d = t("documents")
    return L.check_row(d, "documents have ids", F.count_if(col("doc_id").isNull()), 0).unionByName(L.check_row(d, "no repeated ids", F.count("*") - F.count_distinct("doc_id"), 0))


# ---------------------------------------------------------------- streams (batch form of the same job)
@query(f"select doc_id, sha256({FP}) as fp, len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) as n_words from documents")
def m1_score_messages(t):
    return M.score_messages(t("documents")).select("doc_id", "fp", "n_words")


@query("select user_id, to_timestamp(s * 300)::timestamp as window_start, count(*) as n, count(*) > 2 as over_limit from (select user_id, unnest([epoch_us(ts) // 300000000, epoch_us(ts) // 300000000 - 1]) as s from events where ts is not null) group by user_id, s")
def m4_rate_windows(t):
    return M.rate_windows(t("events"), "user_id", "ts", "10 minutes", "5 minutes", 2)


@query("""with g as (select user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over w >= 3600000000 then 1 else 0 end as new_ from events window w as (partition by user_id order by ts)),
r as (select user_id, ts, sum(new_) over (partition by user_id order by ts, new_ desc rows unbounded preceding) as run from g) select user_id, min(ts) as run_start, count(*) as n from r group by user_id, run""")
def m5_gap_sessions(t):
    return M.gap_sessions(t("events"), "user_id", "ts", "1 hour")
