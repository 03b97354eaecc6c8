"""Threads as a stream: each arriving message is judged against at most 49 earlier ones of its thread, kept as state.

Everything that needs a message alone (keys of names, registered domain, shingles of text and quotation) is a column
expression; the state of a thread holds only those columns of its last messages, its flip point and the time of the last
message. Messages of a thread are taken in the order of time, then key. A message that comes late, but before the
watermark, is judged against the earlier messages that are still known; later rows are dropped by Spark, which counts them
in the progress of the query (``numRowsDroppedByWatermark``). A thread that stays silent for ``idle`` expires by an
event-time timer. The state store must be RocksDB (``use_rocksdb``), which a stateful operator with timers needs; state
is in the checkpoint of the query, so a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from letterspark.functions.text import bind
from letterspark.operators import domains as D
from letterspark.operators import threads as J

#: Columns of a message that its thread keeps.
KEPT = "sent timestamp, msg_key string, from_addr string, name_key string, local_key string, domain string, registered string, label string, skeleton string, network string, family string, message_id string, shingles array<bigint>"
OUTPUT = "thread_id string, msg_key string, n_earlier int, verdicts array<struct<claim_type: string, rule: string, severity: string>>, worst string, flip_key string"
LEVELS = ("low", "medium", "high")


def use_rocksdb(spark: SparkSession) -> None:
    """Chooses the state store; the list of queries is asked for, as a batch finds no coordinator of stores otherwise."""
    spark.streams.active  # noqa: B018
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def prepared(messages: DataFrame, thread: str = "thread_id", letters: int = 5, words: int = 5, quote_words: int = 20) -> DataFrame:
    """What the comparison reads of each message; ``sent`` is a timestamp."""
    name, local = F.regexp_replace(F.lower("from_name"), r"[^\p{L}]+", ""), F.substring_index("from_addr", "@", 1)
    here = F.substring_index("from_addr", "@", -1)

    def hashes(text: str):
        def of(w):
            n = F.size(w) - words + 1
            return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, words), " "))))).otherwise(F.array().cast("array<bigint>"))

        return bind(F.coalesce(J.word_list(text), F.array().cast("array<string>")), of)

    own = D.parts(here)
    ids = F.array_distinct(F.array_compact(F.concat(F.array("in_reply_to"), F.regexp_extract_all(F.coalesce("refs", F.lit("")), F.lit("(<[^<> ]+>)"), F.lit(1)))))
    n_words = F.coalesce(F.size(J.word_list("quoted")), F.lit(0))
    return messages.select(
        F.col(thread).cast("string").alias("thread_id"), "sent", "msg_key", "from_addr", F.when(F.length(name) >= letters, name).alias("name_key"), F.when(F.length(local) >= letters, local).alias("local_key"), here.alias("domain"),
        D.registered(here).alias("registered"), own["name"].alias("label"), D.skeleton(own["name"]).alias("skeleton"), J.network_of(F.col("origin_ip")).alias("network"), J.mailer_family(F.col("mailer")).alias("family"), "message_id",
        hashes("text").alias("shingles"), F.when(n_words >= quote_words, hashes("quoted")).alias("quoted"), n_words.alias("quoted_words"), ids.alias("ids"), "in_reply_to", J.is_reply(F.col("subject")).alias("reply"), J.is_forward(F.col("subject")).alias("forward"),
    )


def _alike(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, 0 to 100."""
    row = [0] * (len(b) + 1)
    for x in a:
        row, before = [0], row
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return round(200.0 * row[-1] / (len(a) + len(b)), 1)


def _status(past: list[dict], me: dict) -> str:
    """The sender against earlier senders: the strongest of the ways in which one is the same or nearly so."""
    if me["from_addr"] is None:
        return "no_from"
    best = None
    for m in past:
        if m["from_addr"] is None or not (m["from_addr"] == me["from_addr"] or m["name_key"] and m["name_key"] == me["name_key"] or m["local_key"] and m["local_key"] == me["local_key"]):
            continue
        if m["from_addr"] == me["from_addr"]:
            return "same_address"
        rank = 1
        if m["domain"] == me["domain"] or m["registered"] and m["registered"] == me["registered"]:
            rank = 0
        elif m["label"] and me["label"]:
            if m["label"] == me["label"]:
                rank = 2
            elif m["skeleton"] == me["skeleton"] or min(len(m["label"]), len(me["label"])) >= 6 and _alike(me["skeleton"], m["skeleton"]) >= 80:
                rank = 3
        best = rank if best is None else max(best, rank)
    return "new_sender" if best is None else ("same_domain", "other_domain", "suffix", "lookalike")[best]


def _new(past: list[dict], me: dict, what: str) -> bool | None:
    seen = {m[what] for m in past if m["from_addr"] == me["from_addr"] and m[what]}
    return me[what] not in seen if me["from_addr"] is not None and me[what] and seen else None


SEVERITY = {
    "tv_single_no_reply_ids": "low", "tv_who_lookalike": "high", "tv_who_suffix": "medium", "tv_who_other_domain": "low", "tv_path_origin_mailer": "medium", "tv_path_origin": "low", "tv_path_mailer": "low", "tv_int_ids_unknown": "medium",
    "tv_int_parent_missing": "low", "tv_quote_mismatch": "high", "tv_single_ids_present": "none", "tv_who_same_address": "none", "tv_who_same_domain": "none", "tv_path_same": "none", "tv_int_ids_ok": "none", "tv_quote_ok": "none",
}


def judge(past: list[dict], me: dict, quote_share: float = 0.3) -> list[dict]:
    """Verdicts of one message against its earlier ones (``threads.signal_ledger`` for one row)."""
    found: list[tuple[str, str]] = []
    if not past:
        rule = "not_reply" if not me["reply"] else "no_quote" if me["quoted_words"] < 20 else "ids_present" if len(me["ids"]) else "no_reply_ids"
        found.append(("single_email", f"tv_single_{rule}"))
    else:
        status = _status(past, me)
        found.append(("sending_path", f"tv_who_{status}"))
        if status == "same_address":
            ip, mailer = _new(past, me, "network"), _new(past, me, "family")
            found.append(("sending_path", "tv_path_" + ("no_data" if ip is None and mailer is None else "origin_mailer" if ip and mailer else "origin" if ip else "mailer" if mailer else "same")))
        sent = {m["message_id"] for m in past}
        known = sum(i in sent for i in me["ids"])
        found.append(("thread_integrity", "tv_int_" + ("no_ids" if not len(me["ids"]) else "ids_unknown" if not known else "parent_missing" if me["in_reply_to"] and me["in_reply_to"] not in sent else "ids_ok")))
        if me["forward"] or me["quoted"] is None:
            found.append(("thread_integrity", "tv_quote_forward" if me["forward"] else "tv_quote_none"))
        else:
            said = set().union(*(m["shingles"] for m in past))
            share = round(sum(h in said for h in me["quoted"]) / len(me["quoted"]), 6)
            found.append(("thread_integrity", "tv_quote_mismatch" if share < quote_share else "tv_quote_ok"))
    return [{"claim_type": kind, "rule": rule, "severity": SEVERITY.get(rule, "not_checkable")} for kind, rule in found]


class ThreadProcessor(StatefulProcessor):
    """Keeps the last messages of a thread and emits one row for each arriving one."""

    def __init__(self, history: int = J.HISTORY, idle: timedelta | None = None):
        """``idle``: how long a silent thread is kept; None where there are no timers, in a batch."""
        self.history, self.idle = history, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getListState("past", KEPT)
        self.flip = handle.getValueState("flip", "sent timestamp, msg_key string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in KEPT.split(", ")]
        blank = lambda v: None if v is None or v is pd.NaT or isinstance(v, float) and v != v else v
        past = [dict(zip(names, row)) for row in self.past.get()] if self.past.exists() else []
        flip = tuple(self.flip.get()) if self.flip.exists() else None
        order = lambda m: (m["sent"], m["msg_key"])
        fresh = sorted(({k: blank(v) for k, v in row.items()} for batch in rows for row in batch.to_dict("records")), key=order)
        out = []
        for me in fresh:
            earlier = [m for m in past if order(m) < order(me)][-self.history :]
            verdicts = judge(earlier, me)
            worst = max((v["severity"] for v in verdicts if v["severity"] in LEVELS), key=LEVELS.index, default=None)
            if earlier and worst in ("medium", "high") and (flip is None or order(me) < flip):
                flip = order(me)
            out.append({"thread_id": key[0], "msg_key": me["msg_key"], "n_earlier": len(earlier), "verdicts": verdicts, "worst": worst, "flip_key": flip[1] if flip else None})
            past = sorted([*past, me], key=order)
        past = past[-self.history :]
        self.past.put([tuple(m[n] if n != "shingles" else list(m[n]) for n in names) for m in past])
        if flip:
            self.flip.update(flip)
        if self.idle is not None:
            self._wait(past[-1]["sent"])
        yield pd.DataFrame(out)

    def _wait(self, last: pd.Timestamp) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = int((pd.Timestamp(last) + self.idle).timestamp() * 1000)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.past, self.flip, self.timer):
            state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def score_threads(messages: DataFrame, thread: str = "thread_id", delay: str = "1 day", idle: timedelta = timedelta(days=30)) -> DataFrame:
    """One row for each dated message: its verdicts, the worst severity and the thread's flip point as known by then; the same in batch and stream."""
    rows = prepared(messages.where("sent is not null"), thread)
    rows = rows.withWatermark("sent", delay) if rows.isStreaming else rows
    return rows.groupBy("thread_id").transformWithStateInPandas(ThreadProcessor(idle=idle if rows.isStreaming else None), OUTPUT, "append", "eventTime" if rows.isStreaming else "none")
