"""Conversations, and comparison of each message with its own past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterspark.functions.text import bind
from letterspark.operators.domains import relation
from letterspark.operators.evaluate import intervals
from letterspark.operators.scoring import wilson
from letterspark.operators.splits import modulo_bucket
from letterspark.plans.components import connected_components
from letterspark.plans.shared import cut

# Prefixes of replies and forwards.
PREFIX = r"(?:(?:re|fw|fwd|aw|sv|antw)[ ]*(?:\[[0-9]{1,5}\][ ]*)?:[ ]*)"


def _line(subject: Column) -> Column:
    return F.lower(F.substring(F.trim(F.regexp_replace(subject, r"[ \t\r\n]+", " ")), 1, 300))


def normalise_subject(subject: Column) -> Column:
    """The squeezed subject, at most 300 characters, in lower case, without up to 20 prefixes."""
    return F.regexp_replace(_line(subject), "^" + PREFIX + "{1,20}", "")


def has_prefix(subject: Column) -> Column:
    """Whether any prefix of a reply or forward begins the subject."""
    return _line(subject).rlike("^" + PREFIX)


def is_reply(subject: Column) -> Column:
    return F.lower(F.trim(subject)).startswith("re:")


def is_forward(subject: Column) -> Column:
    return F.lower(F.trim(subject)).rlike("^fwd?:")


def reply_components(messages: DataFrame, key: str = "msg_key", own: str = "message_id", reply: str = "in_reply_to", references: str | None = None) -> DataFrame:
    """``(msg_key, component)``: messages joined by their ids; a component is its least key. Ids that no message has still join.

    ``references``: a column with further ids in angle brackets.
    """
    rows = messages.select(F.col(key).alias("a"), F.concat(F.lit("~"), F.col(own)).alias("b"))
    rows = rows.unionByName(messages.where(F.col(reply).isNotNull()).select(F.col(key).alias("a"), F.concat(F.lit("~"), F.col(reply)).alias("b")))
    if references is not None:
        ids = F.explode(F.regexp_extract_all(references, F.lit("(<[^<> ]+>)"), F.lit(1)))
        rows = rows.unionByName(messages.select(F.col(key).alias("a"), ids.alias("b")).select("a", F.concat(F.lit("~"), "b").alias("b")))
    found = connected_components(rows).where(~F.col("node").startswith("~"))
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select(F.col("node").alias(key), F.col("least").alias("component"))


def participant_components(messages: DataFrame, run: list[str], key: str = "msg_key", people: str = "people", least: int = 1, most: int = 50) -> DataFrame:
    """``(msg_key, component)``: messages of a run (columns ``run``) that share a participant, directly or through others; runs outside the sizes are left out."""
    sizes = messages.groupBy(*run).agg(F.count("*").alias("_n")).where(F.col("_n").between(least, most)).select(*run)
    place = F.concat_ws("|", F.lit("~"), *run)
    edges = messages.join(sizes, run, "left_semi").select(F.col(key).alias("a"), F.explode_outer(people).alias("person"), place.alias("run"))
    edges = edges.select("a", F.coalesce(F.concat("run", F.lit("|"), "person"), F.concat(F.lit("~"), "a")).alias("b"))
    found = connected_components(edges).where(~F.col("node").startswith("~"))
    names = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(names, "component").select(F.col("node").alias(key), F.col("least").alias("component"))


def ordered(messages: DataFrame, thread: str, ts: str, key: str = "msg_key", label: str = "t") -> DataFrame:
    """Place of each dated message in its thread (by time, then key), the thread's id by its first message, and its split by a hash of the id."""
    w = Window.partitionBy(thread).orderBy(ts, key)
    rows = messages.where(F.col(ts).isNotNull()).withColumn("position", F.row_number().over(w) - 1)
    first = F.first(key).over(w)
    rows = rows.withColumn("thread_id", F.substring(F.sha2(F.concat(F.lit(f"{label}|"), first), 256), 1, 16))
    bucket = modulo_bucket(F.col("thread_id"))
    return rows.withColumn("split", F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test"))


def gap_runs(df: DataFrame, by: list[str], ts: str, row: str, gap_seconds: int) -> DataFrame:
    """Number of the run of each row: a new one after a longer gap."""
    w = Window.partitionBy(*by).orderBy(ts, row)
    new = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w) > gap_seconds
    return df.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new")


def thread_filters(messages: DataFrame, thread: str = "thread_id", ts: str = "sent", least: int = 3, most: int = 50, senders: int = 2, replies: int = 2) -> DataFrame:
    """Why each thread is kept or dropped, judged on its dated messages, and how many have no date."""
    dated = F.col(ts).isNotNull()
    n = messages.groupBy(thread).agg(
        F.count("*").alias("n"), F.count_if(~dated).alias("undated"), F.count_distinct(F.when(dated, F.col("from_addr"))).alias("senders"), F.count_if(dated & has_prefix(F.col("subject"))).alias("replies")
    )
    left = F.col("n") - F.col("undated")
    reason = F.when(F.col("n") < 2, "single").when(left < least, "short").when(left > most, "long").when(F.col("senders") < senders, "one sender").when(F.col("replies") < replies, "few replies").otherwise("kept")
    return n.withColumn("reason", reason)


def size_buckets(messages: DataFrame, thread: str = "thread_id", split: Column | None = None) -> DataFrame:
    """Threads by size (ten or more together), and by split where one is given: the least split of a thread's messages."""
    n = messages.groupBy(thread).agg(F.count("*").alias("n"), *([F.min(split).alias("split")] if split is not None else []))
    keys = (["split"] if split is not None else []) + [F.least(F.col("n"), F.lit(10)).alias("size")]
    return n.groupBy(*keys).agg(F.count("*").alias("threads"))


def onset(df: DataFrame, by: str, order: str, value: str, threshold: float, rise: float = 0.4, least: int = 2) -> DataFrame:
    """Rows above the threshold with none before, that rise over the mean of at least so many earlier rows."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    hit = (F.col(value) >= threshold) & (F.coalesce(F.max(value).over(w), F.lit(-1e9)) < threshold) & (F.col(value) - F.avg(value).over(w) >= rise) & (F.count(value).over(w) >= least)
    return df.withColumn("onset", F.coalesce(hit, F.lit(False)))


def drift(df: DataFrame, by: str, order: str, kind: str, value: str) -> DataFrame:
    """``first``, ``seen`` or ``changed``: a detail against everything of its kind said before."""
    w = Window.partitionBy(by, kind).orderBy(order)
    before = F.min(order).over(w.rowsBetween(Window.unboundedPreceding, 0))
    same = F.min(order).over(Window.partitionBy(by, kind, value).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("drift", F.when(before == F.col(order), "first").when(same < F.col(order), "seen").otherwise("changed"))


def network_of(ip: Column) -> Column:
    """The /24 of an IPv4 address, the first four groups of an IPv6 address, or the value itself."""
    dots = F.size(F.split(ip, r"\.")) == 4
    return F.when(dots, F.substring_index(ip, ".", 3)).when(F.contains(ip, F.lit(":")), F.substring_index(ip, ":", 4)).otherwise(F.nullif(ip, F.lit("")))


def mailer_family(mailer: Column) -> Column:
    """Name of a mail program without its version: its first three words of three letters or more."""
    words = F.regexp_extract_all(F.lower(F.substring(mailer, 1, 200)), F.lit(r"(\p{L}{3,})"), F.lit(1))
    return F.nullif(F.array_join(F.slice(words, 1, 3), " "), F.lit(""))


def path_drift(messages: DataFrame) -> DataFrame:
    """New network and new mail program of a sender that has written before in the thread; NULL where there is nothing to compare with."""
    rows = messages.withColumns({"network": network_of(F.col("origin_ip")), "family": mailer_family(F.col("mailer"))})

    def new(value: str) -> Column:
        sender = Window.partitionBy("thread_id", "from_addr").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
        same = Window.partitionBy("thread_id", "from_addr", value).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
        v = F.col(value)
        return F.when(F.col("from_addr").isNotNull() & v.isNotNull() & (F.count(v).over(sender) > 0), F.count(v).over(same) == 0)

    return rows.select("msg_key", "network", "family", new("network").alias("new_network"), new("family").alias("new_mailer"))


def reference_integrity(messages: DataFrame) -> DataFrame:
    """Of the ids that a message names (parent and references): how many are earlier messages of the thread, and whether the parent is; NULL where none is named."""
    named = F.array_distinct(F.array_compact(F.concat(F.array("in_reply_to"), F.regexp_extract_all(F.coalesce("refs", F.lit("")), F.lit("(<[^<> ]+>)"), F.lit(1)))))
    ids = messages.select("msg_key", "thread_id", "position", "in_reply_to", F.explode(named).alias("id"))
    earlier = messages.select("thread_id", F.col("message_id").alias("id"), F.col("position").alias("p"))
    hit = ids.join(earlier, ["thread_id", "id"], "left").withColumn("known", F.coalesce(F.col("p") < F.col("position"), F.lit(False)))
    n = hit.groupBy("msg_key").agg(F.count("*").alias("total"), F.count_if("known").alias("known"), F.max(F.when(F.col("id") == F.col("in_reply_to"), F.col("known"))).alias("parent_known"))
    return messages.select("msg_key").join(n, "msg_key", "left").select("msg_key", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("known", F.lit(0)).alias("known"), "parent_known")


def word_list(text: str) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")


def quotation_integrity(messages: DataFrame, words: int = 5, least: int = 20) -> DataFrame:
    """How many of a quotation's word shingles an earlier message of the thread holds, and their share; hashed, first position by shingle.

    Short quotations and forwards, which quote from outside, are left out.
    """

    def shingles(text: str) -> Column:
        def of(w: Column) -> Column:  # the words are split once
            n = F.size(w) - words + 1
            return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, words), " ")))))

        return bind(word_list(text), of)

    said = messages.select("thread_id", "position", F.explode(shingles("text")).alias("h")).groupBy("thread_id", "h").agg(F.min("position").alias("first"))
    rows = messages.where("quoted is not null").where(~is_forward(F.col("subject"))).where(F.size(word_list("quoted")) >= least)
    quoted = rows.select("msg_key", "thread_id", "position", F.explode(shingles("quoted")).alias("h"))
    found = quoted.join(said, ["thread_id", "h"], "left")
    n = found.groupBy("msg_key").agg(F.count("*").alias("shingles"), F.count_if(F.col("first") < F.col("position")).alias("known"))
    return n.withColumn("share", F.round(F.col("known") / F.col("shingles"), 6))


#: Earlier messages of a thread that a message is compared with.
HISTORY = 49
_STATES = ("same_domain", "other_domain", "suffix", "lookalike")


def sender_identity(messages: DataFrame, letters: int = 5) -> DataFrame:
    """``(msg_key, n_earlier, status, earlier_domain)``: the sender against the earlier senders of the thread (at most ``HISTORY`` messages back).

    no_from, same_address, same_domain, lookalike, suffix, other_domain (the same name or local part from elsewhere, the strongest) or new_sender.
    Senders are told apart first, so a thread meets itself by its distinct senders only.
    """
    name, local = F.regexp_replace(F.lower("from_name"), r"[^\p{L}]+", ""), F.substring_index("from_addr", "@", 1)
    rows = messages.select("msg_key", "thread_id", "position", "from_addr", F.when(F.length(name) >= letters, name).alias("_n"), F.when(F.length(local) >= letters, local).alias("_l"))
    rows = rows.withColumn("n_earlier", F.least(F.lit(HISTORY), F.col("position")))
    past = cut(rows.where("from_addr is not null").groupBy("thread_id", "from_addr", "_n", "_l").agg(F.collect_set("position").alias("at")))
    past = past.select("thread_id", F.col("from_addr").alias("_a"), F.col("_n").alias("_pn"), F.col("_l").alias("_pl"), "at")
    met = rows.where("from_addr is not null").join(past, "thread_id").where(F.exists("at", lambda x: (x < F.col("position")) & (x >= F.col("position") - HISTORY)))
    same = F.col("_a") == F.col("from_addr")
    met = met.where(same | (F.col("_pn") == F.col("_n")) | (F.col("_pl") == F.col("_l")))
    here, there = F.substring_index("from_addr", "@", -1), F.substring_index("_a", "@", -1)
    r = relation(here, there)
    rank = F.when(same, 9).when(here == there, 0).when(r == "lookalike", 3).when(r == "suffix", 2).when(r == "same", 0).otherwise(1)
    best = met.groupBy("msg_key").agg(F.max(F.struct(rank.alias("r"), F.when(~same, there).alias("d"))).alias("b"))
    state = F.when(F.col("b.r") == 9, "same_address").when(F.col("b.r") == 0, "same_domain").when(F.col("b.r") == 1, "other_domain").when(F.col("b.r") == 2, "suffix").when(F.col("b.r") == 3, "lookalike")
    out = rows.join(best, "msg_key", "left")
    return out.select("msg_key", "n_earlier", F.when(F.col("from_addr").isNull(), "no_from").otherwise(F.coalesce(state, F.lit("new_sender"))).alias("status"), F.col("b.d").alias("earlier_domain"))


def _row(kind: str, *outcomes: tuple[Column | None, str, str]) -> Column:
    """A verdict ``(claim_type, rule, severity)`` of the first condition that holds."""
    out = None
    for condition, rule, severity in outcomes:
        s = F.struct(F.lit(kind).alias("claim_type"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
        out = (F.when(condition, s) if out is None else out.when(condition, s)) if condition is not None else out.otherwise(s)
    return out


def prior_rows(claims: DataFrame, identity: DataFrame) -> DataFrame:
    """Verdicts of claims of an earlier conversation, ``(msg_key, claim_id)``: did the sender take part before?"""
    s, n = F.col("status"), F.coalesce("n_earlier", F.lit(0))
    v = _row(
        "prior_relationship", (n == 0, "tv_prior_no_thread", "not_checkable"), (s == "no_from", "tv_prior_no_from", "not_checkable"), (s.isin("same_address", "same_domain"), "tv_prior_ok", "none"),
        (s.isin("lookalike", "suffix", "other_domain"), "tv_prior_other_address", "low"), (n < 2, "tv_prior_few", "not_checkable"), (None, "tv_prior_stranger", "low"),
    )
    return claims.join(identity, "msg_key", "left").select("msg_key", "claim_id", v.alias("v")).select("msg_key", "claim_id", "v.*")


def signal_ledger(messages: DataFrame, quote_share: float = 0.3) -> DataFrame:
    """``(msg_key, claim_type, rule, contradiction, severity)``: verdicts about each message against its thread, or on its own where it is the first.

    Sender, sending path, named ids and quotation, each a distributed comparison of its own, joined by message.
    """
    who, path, ids, quote = sender_identity(messages), path_drift(messages), reference_integrity(messages), quotation_integrity(messages)
    rows = messages.select("msg_key", "thread_id", "subject", "position", "in_reply_to", "refs", F.size(word_list("quoted")).alias("words"))
    rows = rows.join(who, "msg_key").join(path, "msg_key").join(ids, "msg_key").join(quote.select("msg_key", "share"), "msg_key", "left")
    s, first = F.col("status"), F.col("n_earlier") == 0
    some = F.col("in_reply_to").isNotNull() | (F.coalesce("refs", F.lit("")) != "")
    ip, mailer = F.col("new_network"), F.col("new_mailer")
    verdicts = [
        F.when(first, _row("single_email", (~is_reply(F.col("subject")), "tv_single_not_reply", "not_checkable"), (F.coalesce("words", F.lit(0)) < 20, "tv_single_no_quote", "not_checkable"), (some, "tv_single_ids_present", "none"), (None, "tv_single_no_reply_ids", "low"))),
        F.when(~first, _row("sending_path", (s == "no_from", "tv_who_no_from", "not_checkable"), (s == "same_address", "tv_who_same_address", "none"), (s == "same_domain", "tv_who_same_domain", "none"), (s == "lookalike", "tv_who_lookalike", "high"),
                            (s == "suffix", "tv_who_suffix", "medium"), (s == "other_domain", "tv_who_other_domain", "low"), (None, "tv_who_new_sender", "not_checkable"))),
        F.when(~first & (s == "same_address"), _row("sending_path", (ip.isNull() & mailer.isNull(), "tv_path_no_data", "not_checkable"), (ip & mailer, "tv_path_origin_mailer", "medium"), (ip, "tv_path_origin", "low"), (mailer, "tv_path_mailer", "low"), (None, "tv_path_same", "none"))),
        F.when(~first, _row("thread_integrity", (F.col("total") == 0, "tv_int_no_ids", "not_checkable"), (F.col("known") == 0, "tv_int_ids_unknown", "medium"), (~F.col("parent_known"), "tv_int_parent_missing", "low"), (None, "tv_int_ids_ok", "none"))),
        F.when(~first, _row("thread_integrity", (is_forward(F.col("subject")), "tv_quote_forward", "not_checkable"), (F.col("share").isNull(), "tv_quote_none", "not_checkable"), (F.col("share") < quote_share, "tv_quote_mismatch", "high"), (None, "tv_quote_ok", "none"))),
    ]
    out = rows.withColumn("v", F.explode(F.array_compact(F.array(*verdicts))))
    severity = F.col("v.severity")
    contradiction = F.when(severity.isin("low", "medium", "high"), True).when(severity == "none", False)
    return out.select("msg_key", "thread_id", "position", "v.claim_type", "v.rule", contradiction.alias("contradiction"), severity.alias("severity"))


def signal_rates(ledger: DataFrame, by: str) -> DataFrame:
    """Verdicts by rule, for all and for each value of ``by``."""
    g = ledger.groupingSets([["rule"], ["rule", by]], "rule", by).agg(
        F.count_if("contradiction").alias("contradictions"), F.count_if(~F.col("contradiction")).alias("consistent"), F.count_if(F.col("contradiction").isNull()).alias("not_checkable"), F.grouping(by).alias("g")
    )
    return g.select("rule", F.when(F.col("g") == 1, "all").otherwise(F.col(by).cast("string")).alias(by), "contradictions", "consistent", "not_checkable")


def flip_points(ledger: DataFrame, thread: str = "msg_id", position: str = "position") -> DataFrame:
    """First message after the first with a medium or high contradiction, and the worst severity."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    hit = F.col("contradiction") & (F.col(position) >= 2) & F.col("severity").isin("medium", "high")
    return ledger.groupBy(thread).agg(F.min(F.when(hit, F.col(position))).alias("flip"), F.max(F.when(F.col("contradiction"), rank).otherwise(0)).alias("worst"))


def _per_message(ledger: DataFrame, threads: DataFrame) -> DataFrame:
    """Worst contradiction (0 to 3), whether there is a past, and the rules of weight, a row each message; ``threads``: (thread_id, split, source)."""
    hit = F.coalesce("contradiction", F.lit(False))
    rank = F.when(hit, F.array_position(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("severity"))).otherwise(0)
    fired = F.collect_set(F.when(hit & F.col("severity").isin("medium", "high"), F.struct("rule", "claim_type")))  # at most one row a signal
    rows = ledger.groupBy("msg_key", "thread_id", "position").agg(F.max(rank).alias("worst"), F.bool_and(F.col("claim_type") != "single_email").alias("past"), fired.alias("fired"))
    return rows.join(threads, "thread_id")


def thread_rates(ledger: DataFrame, threads: DataFrame) -> DataFrame:
    """What the thread ledger says on unmodified threads, by split and source: messages, those with a past, flagged and high ones, threads, flagged threads, flips."""
    m = _per_message(ledger, threads)
    flagged = F.col("past") & (F.col("worst") >= 2)
    per = m.groupBy("split", "source", "thread_id").agg(
        F.count("*").alias("messages"), F.count_if("past").alias("judged"), F.count_if(flagged).alias("flagged_messages"), F.count_if(F.col("worst") == 3).alias("high_messages"),
    )
    flips = flip_points(ledger, "thread_id").select("thread_id", F.col("flip").isNotNull().alias("flips"))
    return per.join(flips, "thread_id").groupBy("split", "source").agg(
        *(F.sum(c).alias(c) for c in ("messages", "judged", "flagged_messages", "high_messages")), F.count("*").alias("threads"), F.count_if(F.col("flagged_messages") > 0).alias("flagged_threads"), F.count_if("flips").alias("flips"),
    )


def rule_rates(ledger: DataFrame, threads: DataFrame) -> DataFrame:
    """Verdicts of each rule on unmodified threads by split and source."""
    said = [F.count_if("contradiction").alias("contradiction"), F.count_if(~F.col("contradiction")).alias("consistent"), F.count_if(F.col("contradiction").isNull()).alias("not_checkable")]
    return ledger.join(threads, "thread_id").groupBy("split", "source", "rule", F.col("claim_type").alias("signal")).agg(F.count("*").alias("rows"), *said)


def false_alarms(ledger: DataFrame, threads: DataFrame, draws: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Medium and high contradictions on unmodified threads, where each is a false alarm, among messages with a past.

    Returns a summary by split and source (rate with its Wilson interval, and one over whole threads: ``low``, ``high``) and
    the rates of rules. A message counts once a rule.
    """
    m = _per_message(ledger, threads).where("past").withColumn("flagged", F.col("worst") >= 2)
    by = ["split", "source"]
    n = m.groupBy(*by).agg(F.count_distinct("thread_id").alias("threads"), F.count("*").alias("messages"), F.count_if("flagged").alias("flagged"))
    ends = intervals(m, by, "thread_id", {"a": F.sum(F.col("flagged").cast("int")), "c": F.count("*")}, {"rate": F.try_divide("a", "c")}, draws).select(*by, "low", "high")
    w_low, w_high = wilson(F.col("flagged"), F.col("messages"))
    summary = n.withColumns({"rate": F.round(F.col("flagged") / F.col("messages"), 6), "wilson_low": F.round(w_low, 6), "wilson_high": F.round(w_high, 6)}).join(ends, by)
    hits = m.select(*by, F.explode("fired").alias("f")).groupBy(*by, F.col("f.rule").alias("rule"), F.col("f.claim_type").alias("signal")).agg(F.count("*").alias("messages_flagged"))
    rules = hits.join(n.select(*by, "messages"), by).withColumn("rate", F.round(F.col("messages_flagged") / F.col("messages"), 6))
    return summary, rules
