"""Score, coverage and calibration over a ledger of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterspark.operators.evaluate import intervals
from letterspark.plans.shared import parts

# Points by severity, the lower ends of the bands, what each tactic of pressure adds to the multiplier, and the tactics that score points.
POINTS = {"low": 5.0, "medium": 35.0, "high": 60.0}
BANDS = {"high": 70, "medium": 35, "low": 0}
PRESSURE = {"urgency": 0.25, "secrecy": 0.25}
SCORED_TACTICS = ("authority", "urgency", "scarcity", "secrecy")
TACTIC_POINTS, TACTIC_POINTS_MAX = 4.0, 12.0
#: What to do, by band, and one sentence more by the type of the strongest claim.
ACTIONS = {"low": "Nothing that could be checked was contradicted.", "medium": "Confirm by another route before acting on a request.", "high": "Don't act on this message; report it."}
ADDENDA = {"payment_request": "Pay nothing until it is confirmed.", "data_request": "Send no data until the sender is confirmed.", "authority": "Look up the rank that is claimed.", "reply_direction": "Write to an address you already have."}
SEVERITY = ("none", "low", "medium", "high")


def points(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, value in POINTS.items():
        out = F.when(severity == name, value).otherwise(out)
    return out


def band(score: Column) -> Column:
    return F.when(score >= BANDS["high"], "high").when(score >= BANDS["medium"], "medium").otherwise("low")


def shift(severity: Column, steps: Column) -> Column:
    """Moves up or down the ladder low, medium, high; other values stay."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), severity)
    return F.when(severity.isin(*POINTS), F.element_at(F.array(*map(F.lit, SEVERITY)), F.greatest(F.lit(2), F.least(F.lit(4), rank + steps)).cast("int"))).otherwise(severity)


def _weighted(ledger: DataFrame, reliability: DataFrame | None) -> DataFrame:
    """Rows with their points ``p``, times the factor of their rule."""
    rows = ledger.withColumn("p", points(F.col("severity")))
    return rows if reliability is None else rows.join(reliability.select("rule", "factor"), "rule", "left").withColumn("p", F.col("p") * F.coalesce("factor", F.lit(1.0)))


def strongest(ledger: DataFrame, reliability: DataFrame | None = None) -> DataFrame:
    """The largest weighted points of each message, claim and claim type, over contradictions.

    ``reliability``: a factor for each rule (``reliability`` below), 1 where there is none.
    """
    rows = _weighted(ledger.where("contradiction"), reliability)
    return rows.groupBy("msg_id", "claim_id", "claim_type").agg(F.max("p").alias("p"), F.min_by("rule", F.struct(-F.col("p"), "rule")).alias("rule")).where("p > 0")


def _place() -> Column:
    """The place of a group among those of its message, the strongest first, from 0."""
    return F.row_number().over(Window.partitionBy("msg_id").orderBy(F.desc("p"), "claim_id", "claim_type")) - 1


def _scored(sums: DataFrame, fired: DataFrame | None) -> DataFrame:
    """``sums`` with the score of their ``total`` and its band: times the pressure of tactics, plus their points."""
    raw = F.coalesce("total", F.lit(0.0))
    if fired is not None:
        own = lambda names: F.count_distinct(F.when(F.col("tactic").isin(*names), F.col("tactic")))
        pressure = sum((F.max(F.when(F.col("tactic") == k, v).otherwise(0.0)) for k, v in PRESSURE.items()), F.lit(1.0))
        sums = sums.join(fired.groupBy("msg_id").agg(pressure.alias("_m"), F.least(F.lit(TACTIC_POINTS_MAX), TACTIC_POINTS * own(SCORED_TACTICS)).alias("_t")), "msg_id", "left")
        raw = raw * F.coalesce("_m", F.lit(1.0)) + F.coalesce("_t", F.lit(0.0))
    return sums.withColumn("score", F.least(F.lit(100), F.floor(raw + 0.5)).cast("int")).withColumn("band", band(F.col("score")))


def score(ledger: DataFrame, reliability: DataFrame | None = None, decay: float = 0.5, fired: DataFrame | None = None) -> DataFrame:
    """``(msg_id, score, band, action, top_rule)``: saturating sum of the groups, the k-th strongest times decay^k, times the pressure, plus the points of tactics.

    ``fired``: ``(msg_id, tactic)``. Rounded half up and at most 100; every message of the ledger has a row.
    """
    ranked = strongest(ledger, reliability).withColumn("k", _place())
    sums = ranked.groupBy("msg_id").agg(F.sum(F.round(F.col("p") * F.pow(F.lit(decay), F.col("k")), 2)).alias("total"), F.min_by("claim_type", "k").alias("top"), F.min_by("rule", "k").alias("top_rule"))
    out = _scored(ledger.select("msg_id").distinct().join(sums, "msg_id", "left"), fired)
    text = F.coalesce(*(F.when(F.col("band") == k, F.lit(v)) for k, v in ACTIONS.items()))
    more = F.coalesce(*(F.when(F.col("top") == k, F.lit(" " + v)) for k, v in ADDENDA.items()), F.lit(""))
    return out.select("msg_id", "score", "band", F.when(F.col("band") == "low", text).otherwise(F.concat(text, more)).alias("action"), "top_rule")


def coverage(ledger: DataFrame) -> DataFrame:
    """Claims by status and message: contradicted, consistent or not checkable."""
    claims = ledger.groupBy("msg_id", "claim_id", "claim_type").agg(F.bool_or("contradiction").alias("any"), F.count("contradiction").alias("known"))
    return claims.groupBy("msg_id").agg(
        F.count("*").alias("found"),
        F.count_if(F.col("known") > 0).alias("checked"),
        F.count_if("any").alias("contradicted"),
        F.count_if(~F.col("any")).alias("consistent"),
        F.count_if(F.col("known") == 0).alias("not_checkable"),
    )


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval; NULL for no trials."""
    p, d = hits / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, middle - half), F.when(n > 0, middle + half)


# Shares of checked ordinary messages that may be at high risk, and at medium risk or above.
BUDGET_HIGH, BUDGET_MEDIUM = 0.01, 0.05


def reliability(ledger: DataFrame, ordinary: DataFrame, group: str, judged: int = 20, half: float = BUDGET_MEDIUM, zero: float = 2 * BUDGET_MEDIUM) -> DataFrame:
    """``(rule, group, hits, n, judged, factor)``: how often a rule fires on checked messages of ``ordinary`` (msg_id, group), and the factor (1, 0.5 or 0) by its highest rate among groups with enough hits."""
    rows = ledger.join(ordinary, "msg_id")
    n = rows.where("contradiction is not null").groupBy(group).agg(F.count_distinct("msg_id").alias("n"))
    hits = rows.where("contradiction").groupBy("rule", group).agg(F.count_distinct("msg_id").alias("hits"))
    rates = ledger.select("rule").distinct().crossJoin(n).join(hits, ["rule", group], "left").fillna(0, ["hits"])  # rules and groups: both small
    rates = rates.withColumn("judged", F.col("hits") >= judged)
    worst = F.max(F.when(F.col("judged"), F.col("hits") / F.col("n"))).over(Window.partitionBy("rule"))
    return rates.withColumn("factor", F.when(worst > zero, 0.0).when(worst > half, 0.5).otherwise(1.0))


def budget(scored: DataFrame, group: str, least: int = 20, top: int = 4) -> DataFrame:
    """False alarms of each group of checked ordinary messages with their Wilson intervals, the rules behind most of them, and a verdict: PASS, OVER or info (too few)."""
    alarm = F.col("band") != "low"
    rows = scored.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("band") == "high").alias("high"), F.count_if(alarm).alias("alarms"))
    behind = scored.where(alarm).groupBy(group, "top_rule").agg(F.count("*").alias("c")).withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("c"), "top_rule"))).where(F.col("k") <= top)
    named = F.transform(F.sort_array(F.collect_list(F.struct("k", "top_rule", "c"))), lambda x: F.concat(x["top_rule"], F.lit(":"), x["c"].cast("string")))
    behind = behind.groupBy(group).agg(F.array_join(named, "; ").alias("top_rules"))
    out = rows.join(behind, group, "left")
    ends = {}
    for name in ("high", "alarms"):
        low, high = wilson(F.col(name), F.col("n"))
        ends |= {f"{name}_low": F.round(low, 6), f"{name}_high": F.round(high, 6)}
    over = (F.col("high") / F.col("n") > BUDGET_HIGH) | (F.col("alarms") / F.col("n") > BUDGET_MEDIUM)
    return out.withColumns(ends).withColumn("verdict", F.when(F.col("n") < least, "info").when(over, "OVER").otherwise("PASS"))


def verdict_rates(ledger: DataFrame) -> DataFrame:
    """Verdict counts by claim type and verifier, with margins."""
    g = ledger.cube("claim_type", "verifier").agg(
        F.count_distinct("msg_id").alias("messages"), F.count_if("contradiction").alias("contradictions"), F.count_if(~F.col("contradiction")).alias("consistent"),
        F.count_if(F.col("contradiction").isNull()).alias("not_checkable"), F.grouping("claim_type").alias("g1"), F.grouping("verifier").alias("g2"),
    )
    return g.select(
        F.when(F.col("g1") == 1, "any").otherwise(F.col("claim_type")).alias("claim_type"), F.when(F.col("g2") == 1, "any").otherwise(F.col("verifier")).alias("verifier"), "messages", "contradictions", "consistent", "not_checkable"
    )


def rule_table(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits of every rule, silent ones too, with their share of the verifier's rows."""
    n = ledger.groupBy("verifier", "rule").agg(F.count("*").alias("n_rows"), F.count_if("contradiction").alias("contradictions"))
    total = Window.partitionBy("verifier")
    out = rules.join(n, ["verifier", "rule"], "left").fillna(0, ["n_rows", "contradictions"])
    return out.withColumn("share", F.when(F.sum("n_rows").over(total) > 0, F.round(F.col("n_rows") / F.sum("n_rows").over(total), 6)))


def top_reasons(ledger: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent rules behind claims that aren't checkable, by claim type."""
    counts = ledger.where("contradiction is null").groupBy("claim_type", "rule").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("claim_type").orderBy(F.desc("n"), "rule"))).where(F.col("rank") <= n)


# The points that calibration tries, and where it starts from.
GRID = [(h, m, p) for h in (50.0, 60.0, 70.0) for m in (25.0, 35.0, 45.0) for p in (0.15, 0.25, 0.35)]
START = (60.0, 35.0, 0.25)


def calibrate(ledger: DataFrame, ordinary: DataFrame, group: str, fired: DataFrame, least: int = 20, high_budget: float = BUDGET_HIGH, medium_budget: float = BUDGET_MEDIUM, decay: float = 0.5) -> DataFrame:
    """All configurations of ``GRID`` with their false alarms in the groups of ``ordinary`` (msg_id, group), and the one to keep.

    Scores depend on a message only through its numbers of high, medium and low findings and its tactics: messages
    are counted by these once, and the few patterns meet the configurations. ``chosen``: of those that keep the meaning
    of the bands and the budget, the nearest to the start (then fewest points); the start if none does.
    """
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1)
    claims = ledger.where("contradiction").groupBy("msg_id", "claim_id", "claim_type").agg(F.max(rank).alias("r"))
    n = claims.groupBy("msg_id").agg(*(F.count_if(F.col("r") == k).alias(name) for name, k in (("h", 3), ("m", 2), ("l", 1))))
    own = lambda names: F.count_distinct(F.when(F.col("tactic").isin(*names), F.col("tactic")))
    tactics = fired.groupBy("msg_id").agg(own(tuple(PRESSURE)).alias("pressure"), F.least(F.lit(TACTIC_POINTS_MAX), TACTIC_POINTS * own(SCORED_TACTICS)).alias("extra"))
    checked = ledger.where("contradiction is not null").select("msg_id").distinct().join(ordinary, "msg_id")
    rows = checked.join(n, "msg_id", "left").join(tactics, "msg_id", "left").fillna(0, ["h", "m", "l", "pressure", "extra"])
    patterns = rows.groupBy(group, "h", "m", "l", "pressure", "extra").agg(F.count("*").alias("n"))
    grid = ledger.sparkSession.createDataFrame([(*p, k) for k, p in enumerate(GRID)], "high_points double, medium_points double, step double, config int")
    each = patterns.crossJoin(F.broadcast(grid))  # 27 rows
    found = F.concat(F.array_repeat("high_points", F.col("h").cast("int")), F.array_repeat("medium_points", F.col("m").cast("int")), F.array_repeat(F.lit(POINTS["low"]), F.col("l").cast("int")))
    total = F.aggregate(F.transform(found, lambda p, k: F.round(p * F.pow(F.lit(decay), k), 2)), F.lit(0.0), lambda a, b: a + b)
    s = F.least(F.lit(100), F.floor(total * (1 + F.col("step") * F.col("pressure")) + F.col("extra") + 0.5))
    bands = each.withColumn("s", s).groupBy("config", "high_points", "medium_points", "step", group).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("s") >= BANDS["high"], F.col("n")).otherwise(0)).alias("high"), F.sum(F.when(F.col("s") >= BANDS["medium"], F.col("n")).otherwise(0)).alias("alarms")
    )
    over = (F.col("high") / F.col("n") > high_budget) | (F.col("alarms") / F.col("n") > medium_budget)
    out = bands.where(F.col("n") >= least).groupBy("config", "high_points", "medium_points", "step").agg(
        F.count("*").alias("groups"), F.count_if(over).alias("over"), F.round(F.max(F.col("high") / F.col("n")), 6).alias("worst_high"), F.round(F.max(F.col("alarms") / F.col("n")), 6).alias("worst_alarms")
    )
    h, m, p = F.col("high_points"), F.col("medium_points"), F.col("step")
    meaning = m.between(BANDS["medium"], BANDS["high"] - 1e-9) & h.between(BANDS["medium"], BANDS["high"] - 1e-9) & (m < h) & (h * (1 + p) + TACTIC_POINTS >= BANDS["high"])
    distance = F.round(F.abs(h - START[0]) / 10 + F.abs(m - START[1]) / 10 + F.abs(p - START[2]) / 0.1, 2)
    out = out.withColumns({"meaning": meaning, "distance": distance})
    fits = F.col("meaning") & (F.col("over") == 0)
    best = F.min(F.when(fits, F.struct("distance", "high_points", "medium_points", "step"))).over(Window.partitionBy())  # 27 rows
    out = out.withColumn("_b", best)
    start = (h == START[0]) & (m == START[1]) & (p == START[2])
    return out.withColumn("chosen", F.when(F.col("_b").isNull(), start).otherwise((h == F.col("_b.high_points")) & (m == F.col("_b.medium_points")) & (p == F.col("_b.step")))).drop("_b", "config")


def units(ledger: DataFrame, reliability: DataFrame | None = None, decay: float = 0.5, fired: DataFrame | None = None) -> DataFrame:
    """One scoring unit for each message of a ledger: claims, checked and contradicted verdicts, score and band (those of ``score``).

    The ledger is read once: groups without points stay, so their message has a row and their verdicts are counted.
    """
    c = F.col
    groups = _weighted(ledger.where("msg_id is not null"), reliability).groupBy("msg_id", "claim_id", "claim_type").agg(F.max(F.when(c("contradiction"), c("p"))).alias("p"), F.count("contradiction").alias("checked"), F.count_if("contradiction").alias("contradictions"))
    ranked = groups.withColumn("p", F.when(c("p") > 0, c("p"))).withColumn("k", _place())
    n = ranked.groupBy("msg_id").agg(
        F.count_distinct("claim_id").alias("claims"), F.sum("checked").alias("checked"), F.sum("contradictions").alias("contradictions"), F.sum(F.round(c("p") * F.pow(F.lit(decay), c("k")), 2)).alias("total"),
    )
    return _scored(n, fired).select("msg_id", "claims", "checked", "contradictions", "score", "band")


def system_rates(df: DataFrame, group: str, system: str, hit: Column) -> DataFrame:
    """Rate and Wilson interval of each system, for all and by group."""
    g = df.groupingSets([[system], [group, system]], group, system).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.grouping(group).alias("g"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.col(group)).alias("source"), system, "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def compare_runs(now: DataFrame, before: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """A table against that of an earlier run: change of a value, and whether it is new, steady or changed."""
    out = now.select(*keys, F.col(value).alias("now")).join(before.select(*keys, F.col(value).alias("before")), keys, "left")
    change = F.round(F.col("now") - F.col("before"), 4)
    return out.withColumns({"change": change, "state": F.when(F.col("before").isNull(), "new").when(F.abs(F.col("now") - F.col("before")) <= tolerance, "steady").otherwise("changed")})


def paired_differences(df: DataFrame, cluster: str, truth: Column, one: Column, two: Column, draws: int = 1000) -> DataFrame:
    """``(statistic, value, low, high)``: recall and false alarms of the second system less those of the first, over shared draws of clusters."""
    sums = {"pos": F.count_if(truth), "neg": F.count_if(~truth), "t1": F.count_if(truth & one), "t2": F.count_if(truth & two), "f1": F.count_if(~truth & one), "f2": F.count_if(~truth & two)}
    c = F.col
    return intervals(df, [], cluster, sums, {"recall": c("t2") / c("pos") - c("t1") / c("pos"), "false alarms": c("f2") / c("neg") - c("f1") / c("neg")}, draws)


#: What kept a check from running, in words, by code.
LIMITS = {
    "headers_missing": "There was no header block.", "no_from": "There was no usable sender.", "no_authentication": "No result of SPF, DKIM or DMARC was found.",
    "no_org_domain": "The reader's organisation isn't known.", "org_domain_ignored": "The organisation given wasn't usable.", "single_email": "There was no earlier message to compare with.",
    "thread_truncated": "Only the last messages of the thread were read.", "thread_unordered": "Messages without a date were taken in the order given.", "text_truncated": "The text was cut at its limit.",
    "mime_too_deep": "Parts of the message were nested too deeply.",
}


def coverage_report(messages: DataFrame, ledger: DataFrame, claims: DataFrame, limits: DataFrame, signal_id: str = "thread") -> DataFrame:
    """How much of each message could be checked: claims and thread signals by status, limits that applied, and a note; a row for each of ``messages`` (msg_id).

    A claim counts once, whatever the number of its rows: a contradiction wins, then a passed check. Rows on claims that weren't
    found (``claims``: msg_id, claim_id) don't count. Signals are rows under ``signal_id``, one each; those of type
    ``single_email`` don't look at history. ``limits``: (msg_id, code), codes that aren't known are passed over. All rows are
    dealt by message in as many parts as the ledger asks for, so what a task holds doesn't grow with it.
    """
    n = parts(ledger)
    signal = F.coalesce(F.col("claim_id") == signal_id, F.lit(False))
    # verdicts and claims that were found meet in one grouping: neither is sorted or made distinct first
    met = ledger.where(~signal).select("msg_id", "claim_id", "contradiction", F.lit(True).alias("_verdict")).unionByName(claims.select("msg_id", "claim_id", F.lit(None).cast("boolean").alias("contradiction"), F.lit(False).alias("_verdict")))
    status = met.where("msg_id is not null and claim_id is not null").repartition(n, "msg_id").groupBy("msg_id", "claim_id").agg(F.bool_or("contradiction").alias("s"), F.bool_or("_verdict").alias("_v"), F.bool_and("_verdict").alias("_lost"))
    status = status.where("_v and not _lost")
    per_claim = status.groupBy("msg_id").agg(
        F.count("*").alias("claims"), F.count("s").alias("checked"), F.count_if("s").alias("contradicted"), F.count_if(~F.col("s")).alias("consistent"), F.count_if(F.col("s").isNull()).alias("not_checkable")
    )
    history = F.coalesce(F.col("claim_type") != "single_email", F.lit(True))
    per_signal = ledger.where(signal).select("msg_id", "claim_type", "contradiction").repartition(n, "msg_id").groupBy("msg_id").agg(
        F.count("*").alias("signals"), F.count_if("contradiction").alias("signals_contradicted"), F.count_if(F.col("contradiction").isNull()).alias("signals_not_checkable"),
        F.count_if(history).alias("history"), F.count_if(history & F.col("contradiction").isNotNull()).alias("history_ran"),
    )
    known = limits.where(F.col("code").isin(*LIMITS)).select("msg_id", "code").repartition(n, "msg_id").groupBy("msg_id").agg(F.array_sort(F.collect_set("code")).alias("limits"))
    out = messages.select("msg_id").repartition(n, "msg_id").distinct().join(per_claim, "msg_id", "left").join(per_signal, "msg_id", "left").join(known, "msg_id", "left")
    counts = [c for c in out.columns if c not in ("msg_id", "limits")]
    out = out.fillna(0, counts).withColumn("limits", F.coalesce("limits", F.array().cast("array<string>")))
    text = {c: F.col(c).cast("string") for c in counts}
    said = F.when(F.col("claims") == 0, "No claim that can be checked was found.").otherwise(F.concat(text["checked"], F.lit(" of "), text["claims"], F.lit(" claims could be checked.")))
    ran = F.when(F.col("history") > 0, F.concat(F.lit(" "), text["history_ran"], F.lit(" of "), text["history"], F.lit(" checks against the thread ran."))).otherwise("")
    texts = F.create_map(*(F.lit(x) for pair in LIMITS.items() for x in pair))
    why = F.array_join(F.transform("limits", lambda code: F.concat(F.lit(" "), F.try_element_at(texts, code))), "")
    return out.withColumn("note", F.concat(said, ran, why)).drop("history", "history_ran")


def scored_both(cases: DataFrame, ledger: DataFrame, verifier: str = "thread") -> DataFrame:
    """Cases (msg_id and their columns) with score and band by the whole ledger (``_full``) and without one verifier's findings (``_without``); a case without findings scores 0."""
    out = cases
    for name, rows in (("full", ledger), ("without", ledger.where(F.col("verifier") != verifier))):
        scored = score(rows).select("msg_id", F.col("score").alias(f"score_{name}"))
        out = out.join(scored, "msg_id", "left").withColumn(f"score_{name}", F.coalesce(f"score_{name}", F.lit(0))).withColumn(f"band_{name}", band(F.col(f"score_{name}")))
    return out


def case_table(detail: DataFrame, by: list[str], cluster: str, draws: int = 1000) -> DataFrame:
    """``(*by, variant, metric, n, hits, rate, low, high)``: shares of cases at medium or above and at high, with and without a verifier; attacks (label 1) also together, intervals over clusters."""
    both = F.when(F.col("label") == 1, F.array("variant", F.lit("attacks"))).otherwise(F.array("variant"))
    metrics = {f"{k}_{name}": F.col(f"band_{name}") == "high" if k == "high" else F.col(f"band_{name}") != "low" for name in ("full", "without") for k in ("some", "high")}
    rows = detail.withColumn("variant", F.explode(both)).select(*by, "variant", cluster, *(v.alias(k) for k, v in metrics.items()))
    key, n = [*by, "variant", "metric"], F.col("_n")
    # metrics side by side: a cluster has one row for each group, not one for each metric
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("hits")) for k in metrics))).alias("m")
    counts = rows.groupBy(*by, "variant").agg(F.count("*").alias("n"), *(F.count_if(k).alias(k) for k in metrics)).select(*by, "variant", "n", each).select(*by, "variant", "m.metric", "n", "m.hits")
    sums = {k: F.sum(F.col(k).cast("int")) for k in metrics} | {"_n": F.count("*")}
    ends = intervals(rows, [*by, "variant"], cluster, sums, {k: F.try_divide(F.col(k), n) for k in metrics}, draws).withColumnRenamed("statistic", "metric").select(*key, "low", "high")
    return counts.withColumn("rate", F.round(F.col("hits") / F.col("n"), 6)).join(ends, key)
