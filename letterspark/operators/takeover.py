"""Takeovers of threads by rewriting: eligible points, a plan in hash order, five variants a point, and their judgement.

A case is the thread up to a point and one message in its place: the real one, a plain one (both negative), one with an
attack from the real sender (A), one from a look-alike domain over a path the sender never used (B), and one that quotes
and names a conversation that never was (C). What an attacker can't change is copied from the real message. All cases are
rows of one table of threads, so they are judged by the same joins as any thread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterspark.functions.text import bind
from letterspark.operators import domains as D
from letterspark.operators import splits as C
from letterspark.operators import threads as J
from letterspark.operators.evaluate import intervals
from letterspark.plans.shared import stored

# Variants and their labels, forged ids, mail programs, swaps of letters that look alike.
LABELS = {"neg_real": 0, "neg_synth": 0, "A": 1, "B": 1, "C": 1}
FORGED = ("<forged-1@thread.invalid>", "<forged-2@thread.invalid>")
MAILERS = ("Microsoft Outlook 16.0", "Mozilla Thunderbird 102", "Roundcube Webmail 1.6", "Gmail web client", "Mutt 2.2.9", "Evolution 3.40")
SWAPS = (("l", "1"), ("o", "0"), ("e", "3"), ("m", "rn"))
GOALS = ("change_bank", "credential", "gift_card", "payment")
LEAST_WORDS, QUOTE_WORDS, QUOTED = 5, 20, 120
#: Cases below which a rate is only counted.
LEAST_CASES = 10
MESSAGE = ("msg_key", "position", "from_addr", "from_name", "message_id", "in_reply_to", "refs", "subject", "origin_ip", "mailer", "text", "quoted")


def eligible(messages: DataFrame) -> DataFrame:
    """``(thread_id, source, position)`` where a takeover could begin: after two messages, with words to answer and to quote; where ids are kept (``with_ids``), by a sender with a known path."""
    w = Window.partitionBy("thread_id").orderBy("position")
    same = Window.partitionBy("thread_id", "from_addr").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.size(J.word_list("text")), F.lit(0))
    path = F.coalesce(F.max(F.col("origin_ip").isNotNull() | F.col("mailer").isNotNull()).over(same), F.lit(False)) & F.col("from_addr").isNotNull()
    ids = F.col("message_id").isNotNull() & F.lag("message_id").over(w).isNotNull()
    rows = messages.withColumns({"_n": size, "_before": F.lag(size).over(w), "_path": path & ids})
    return rows.where((F.col("position") >= 2) & (F.col("_n") >= LEAST_WORDS) & (F.col("_before") >= QUOTE_WORDS) & (~F.col("with_ids") | F.col("_path"))).select("thread_id", "source", "position")


def make_plan(messages: DataFrame, target: int) -> DataFrame:
    """``(thread_id, source, split, index, goal)``: of each source the first ``target`` threads with an eligible point, in hash order, at one point each."""
    place = lambda tag: C.position(F.concat(F.lit(f"{tag}|"), F.col("thread_id").cast("string")))
    points = eligible(messages).groupBy("thread_id", "source").agg(F.sort_array(F.collect_list("position")).alias("at"))  # at most the messages of a thread
    order = Window.partitionBy("source").orderBy(place("order"), "thread_id")
    chosen = points.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= target)
    bucket = place("split")
    return chosen.select(
        "thread_id", "source", F.when(bucket < 0.7, "train").when(bucket < 0.85, "validation").otherwise("test").alias("split"), F.get("at", F.floor(place("k") * F.size("at")).cast("int")).alias("index"),
        F.get(F.array(*map(F.lit, GOALS)), F.floor(place("goal") * len(GOALS)).cast("int")).alias("goal"),
    )


def lookalike_of(domain: Column) -> Column:
    """The registered domain with the first swap that the comparison takes for a look-alike; NULL if none."""

    def tried(p: Column) -> Column:
        name, tries = p["name"], []
        for old, new in SWAPS:
            at = F.locate(old, name)
            made = F.concat(F.substr(name, F.lit(1), at - 1), F.lit(new), F.substr(name, at + len(old), F.length(name)))
            tries.append(F.when((at > 0) & D.names_alike(made, name), made))
        return F.concat(F.coalesce(*tries), F.lit("."), p["suffix"])

    return bind(D.parts(domain), tried)


def build_cases(messages: DataFrame, plan: DataFrame, injections: DataFrame) -> DataFrame:
    """The messages of all cases: those of ``MESSAGE`` with ``case_id`` as ``thread_id``, and ``(thread, source, split, variant, label, index, injected)``.

    ``injections``: ``(thread_id, attack_body, benign_body, fake_quote)``. B is left out where the sender's domain has no look-alike.
    """
    base = plan.join(injections, "thread_id")
    rows = messages.drop("source").join(base, "thread_id").where(F.col("position") <= F.col("index"))
    message = F.struct(*MESSAGE, "with_ids")
    at = F.col("position") - F.col("index")
    real = rows.where(at == 0).select("thread_id", *base.columns[1:], message.alias("real"))
    previous = rows.where(at == -1).select("thread_id", message.alias("previous"))
    sender = real.select("thread_id", F.col("real.from_addr").alias("_a"))
    mine = rows.where(at < 0).join(sender, "thread_id").where(F.col("from_addr") == F.col("_a"))
    mine = mine.groupBy("thread_id").agg(F.max(F.struct("position", "origin_ip", "mailer")).alias("latest"), F.collect_set(J.mailer_family(F.col("mailer"))).alias("families"))
    points = real.join(previous, "thread_id").join(mine, "thread_id", "left").withColumn("alike", lookalike_of(F.substring_index("real.from_addr", "@", -1)))
    cases = points.withColumn("variant", F.explode(F.array(*map(F.lit, LABELS)))).where((F.col("variant") != "B") | (F.col("alike").isNotNull() & F.col("real.with_ids")))
    v, ids = F.col("variant"), F.col("real.with_ids")
    is_real, answers = v == "neg_real", v.isin("neg_synth", "A", "B")
    of = lambda name: F.col(f"real.{name}")
    unused = reduce(lambda a, b: F.coalesce(a, b), (F.when(~F.coalesce(F.array_contains("families", J.mailer_family(F.lit(m))), F.lit(False)), m) for m in MAILERS))
    latest = lambda name: F.coalesce(F.col(f"latest.{name}"), F.when(F.col("latest").isNull(), of(name)))
    number = 1 + F.floor(C.position(F.concat(F.lit("path|"), F.col("thread_id").cast("string"))) * 250)
    quote = F.array_join(F.slice(F.filter(F.split("previous.text", r"[ \t\r\n]+"), lambda w: w != ""), 1, QUOTED), " ")
    made = {
        "msg_key": F.concat(F.lit("inj|"), F.col("thread_id").cast("string"), F.lit("|"), v), "position": of("position"), "from_addr": F.when(v == "B", F.concat(F.substring_index(of("from_addr"), "@", 1), F.lit("@"), F.col("alike"))).otherwise(of("from_addr")),
        "from_name": of("from_name"), "message_id": F.when(is_real, of("message_id")).otherwise(F.concat(F.lit("<inj-"), F.col("thread_id").cast("string"), F.lit("@thread.invalid>"))),
        "in_reply_to": F.when(is_real, of("in_reply_to")).when(ids & answers, F.col("previous.message_id")).when(ids, FORGED[1]),
        "refs": F.when(is_real, of("refs")).when(ids & answers, F.concat_ws(" ", F.nullif("previous.refs", F.lit("")), "previous.message_id")).when(ids, " ".join(FORGED)).otherwise(""),
        "subject": of("subject"), "origin_ip": F.when(is_real, of("origin_ip")).when(v == "B", F.concat(F.lit("198.51.100."), number)).otherwise(latest("origin_ip")),
        "mailer": F.when(is_real, of("mailer")).when(v == "B", unused).otherwise(latest("mailer")), "text": F.when(is_real, of("text")).when(v == "A", F.col("attack_body")).otherwise(F.col("benign_body")),
        "quoted": F.when(is_real, of("quoted")).when(answers, quote).otherwise(F.col("fake_quote")),
    }
    case_id = F.concat(F.col("thread_id").cast("string"), F.lit("|"), v)
    label = F.when(v.isin(*(x for x, y in LABELS.items() if y)), 1).otherwise(0)
    about = [case_id.alias("case_id"), F.col("thread_id").cast("string").alias("thread"), "source", "split", v, label.alias("label"), "index"]
    injected = cases.select(*about, F.lit(True).alias("injected"), *(c.alias(k) for k, c in made.items()))
    kept = rows.where(at < 0).select("thread_id", *MESSAGE).join(cases.select("thread_id", *about[:1], *about[2:]), "thread_id")
    kept = kept.select("case_id", F.col("thread_id").cast("string").alias("thread"), "source", "split", "variant", "label", "index", F.lit(False).alias("injected"), *(F.concat("case_id", F.lit("|"), k).alias(k) if k == "msg_key" else F.col(k) for k in MESSAGE))
    return kept.unionByName(injected).withColumn("thread_id", F.col("case_id"))


def judge(cases: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """``(case_id, thread, source, split, variant, label, index, found, base, groups, flip)`` of each case by the thread ledger.

    ``baseline``: ``(case_id, base)``, what other verifiers find in the injected message. ``groups``: signals that fired there.
    """
    cases = stored(cases)  # read by each of the ledger's comparisons
    ledger = J.signal_ledger(cases.drop("source", "split", "label"))
    hit = F.col("contradiction") & F.col("severity").isin("medium", "high")
    fired = ledger.withColumn("hit", F.coalesce(hit, F.lit(False))).where("hit").select(F.col("thread_id").alias("case_id"), "position", F.when(F.col("claim_type") == "sending_path", "path").when(F.col("claim_type") == "thread_integrity", "integrity").otherwise("single").alias("group"))
    one = cases.where("injected").select("case_id", "thread", "source", "split", "variant", "label", "index")
    n = one.join(fired, "case_id", "left").groupBy(*one.columns).agg(
        F.sort_array(F.collect_set(F.when(F.col("position") == F.col("index"), F.col("group")))).alias("groups"), F.min(F.when(F.col("position") >= 1, F.col("position"))).alias("flip")
    )
    n = n.join(baseline, "case_id", "left") if baseline is not None else n.withColumn("base", F.lit(False))
    return n.select(*one.columns, (F.size("groups") > 0).alias("found"), F.coalesce("base", F.lit(False)).alias("base"), "groups", "flip")


def score_table(judged: DataFrame, draws: int = 1000) -> DataFrame:
    """``(split, source, variant, metric, n, hits, rate, low, high)``; attacks also together; no rate below ``LEAST_CASES`` cases, intervals over threads."""
    each = judged.withColumn("variant", F.explode(F.when(F.col("label") == 1, F.array("variant", F.lit("attacks"))).otherwise(F.array("variant"))))
    found, base = F.col("found"), F.col("base")
    attack = {
        "detect": found, "detect_base": base, "detect_either": found | base, "gain": found & ~base, "signal_path": F.array_contains("groups", "path"), "signal_integrity": F.array_contains("groups", "integrity"),
        "flip_exact": F.coalesce(F.col("flip") == F.col("index"), F.lit(False)), "flip_early": F.coalesce(F.col("flip") < F.col("index"), F.lit(False)),
    }
    ordinary = {"false_alarm": found, "false_alarm_base": base, "false_alarm_either": found | base, "false_alarm_scan": F.col("flip").isNotNull()}
    rows = lambda metrics: F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("hit")) for k, v in metrics.items()))
    long = each.select("split", "source", "variant", "thread", F.explode(F.when(F.col("label") == 1, rows(attack)).otherwise(rows(ordinary))).alias("m")).select("split", "source", "variant", "thread", "m.*")
    by = ["split", "source", "variant", "metric"]
    n = long.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    ends = intervals(long, by, "thread", {"h": F.count_if("hit"), "n": F.count("*")}, {"rate": F.try_divide("h", "n")}, draws).select(*by, "low", "high")
    enough = F.col("n") >= LEAST_CASES
    return n.join(ends, by).select(*by, "n", "hits", *(F.when(enough, v).alias(k) for k, v in (("rate", F.round(F.col("hits") / F.col("n"), 6)), ("low", F.col("low")), ("high", F.col("high")))))


def isolation_checks(judged: DataFrame) -> DataFrame:
    """``(check, value, status)``: threads in one split, all four variants of each, labels, and no signal where its details were copied."""
    groups = {"A": ("path", "integrity"), "B": ("integrity",), "C": ("path",), "neg_synth": ("path", "integrity")}
    per = judged.groupBy("thread").agg(F.count_distinct("split").alias("splits"), F.collect_set("variant").alias("v"))
    structure = per.agg(F.count_if(F.col("splits") > 1).alias("threads in several splits"), F.count_if(~F.forall(F.array(*map(F.lit, ("neg_real", "neg_synth", "A", "C"))), lambda x: F.array_contains("v", x))).alias("threads without a variant"))
    label = F.when(F.col("variant").isin("A", "B", "C"), 1).otherwise(0)
    broken = judged.agg(F.count_if(F.col("label") != label).alias("wrong labels"), *(F.count_if((F.col("variant") == k) & F.arrays_overlap("groups", F.array(*map(F.lit, g)))).alias(f"{k} fires {'/'.join(g)}") for k, g in groups.items()))
    out = None
    for table in (structure, broken):
        part = table.unpivot([], table.columns, "check", "value")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("status", F.when(F.col("value") == 0, "PASS").otherwise("FAIL"))
