"""Stream forms: the same expressions over arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterspark.functions.text import has_link, redact, word_count
from letterspark.operators.staging import fingerprint


def score_messages(stream: DataFrame, text: str = "text") -> DataFrame:
    """Stateless features of arriving messages; batch and stream give equal rows."""
    t = F.col(text)
    return stream.withColumns({"fp": fingerprint(t), "redacted": redact(t), "has_link": has_link(t), "n_words": word_count(t)})


def drop_repeats(stream: DataFrame, ts: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rate_windows(df: DataFrame, client: str, ts: str, size: str, slide: str, limit: int, delay: str = "1 hour") -> DataFrame:
    """Events of each client in moving windows, with a flag for those over the limit."""
    n = (df.withWatermark(ts, delay) if df.isStreaming else df).groupBy(F.window(ts, size, slide).alias("w"), client).agg(F.count("*").alias("n"))
    return n.select(client, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("over_limit"))


def gap_sessions(df: DataFrame, by: str, ts: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Runs of events that are less than ``gap`` apart."""
    n = (df.withWatermark(ts, delay) if df.isStreaming else df).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return n.select(by, F.col("w.start").alias("run_start"), "n")
