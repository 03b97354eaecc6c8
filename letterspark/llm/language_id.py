"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (one to three characters of lower-case letters, other
characters as a space) of every training text by language, in one pass with a partial
aggregation; only the table of counts, languages times 2^15, reaches the driver. The
matrix of smoothed log-probabilities is broadcast, and texts are scored in sparse batches
in numpy: gather the rows of a batch's n-grams and add them up per text. Languages come in
blocks of at most ``BLOCK`` by name, each a matrix and a broadcast of its own, so that any
number of languages is learned; the best of all blocks wins.

Defined results: a null text and a text without a letter get ``und`` and score 0. Rows
with a null language or such a text don't train. Without training rows every text gets
``und``. The score is the posterior probability of the predicted language; among equal
scores the first language by name wins. A null id counts as an empty string in the fold.
Repeated rows count as often as they occur. Long texts are counted and scored in parts that
add up to the whole. ``predict`` keeps other columns and replaces one of the output's name;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterspark.llm.char_grams import bucket_parts, letter_runs
from letterspark.llm.common import bound_batches, chunks, fresh, publish

ORDERS, BITS = (1, 2, 3), 15
#: Languages in a block at most: bounds a broadcast matrix (128 KB a language) and a table that reaches the driver.
BLOCK = 128
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters scored at a time.
CHUNK = 1 << 18
_COUNTS = "lang string, bucket int, n long"


def fold(id_col: str, n: int) -> Column:
    """Remainder of the CRC-32 of the id as text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, bucket, n) of each task; bucket -1: texts."""
    sums: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array((at - 1).astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])
        sums.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            x = letter_runs(text.as_py())
            if len(x):
                n = sums.setdefault(lang.as_py(), np.zeros((1 << BITS) + 1, np.int64))
                n[0] += 1
                for part in bucket_parts(x, ORDERS, BITS, CHUNK):
                    n[1:] += np.bincount(part, minlength=1 << BITS)
        if len(sums) > BLOCK:
            yield from rows()
    yield from rows()


#: Languages in order of name, log-probabilities (buckets x languages), log priors.
Model = tuple[list[str], np.ndarray, np.ndarray]


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[Model]:
    """The models of all blocks of languages; none without training rows."""
    bound_batches(rows)
    data = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = publish(data.mapInArrow(_count, _COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    texts = {r.lang: r.n for r in counts.where("bucket = -1").select("lang", "n").orderBy("lang").collect()}  # one row a language
    langs, models = list(texts), []
    for k in range(0, len(langs), BLOCK):
        some = langs[k : k + BLOCK]
        table = counts.where(F.col("lang").isin(some) & (F.col("bucket") >= 0)).toArrow()
        at = {lang: k for k, lang in enumerate(some)}
        n = np.zeros((1 << BITS, len(some)))
        n[table.column("bucket").to_numpy(), [at[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
        log_p = np.log(n + SMOOTHING) - np.log((n + SMOOTHING).sum(0))
        models.append((some, log_p.astype(np.float32), np.log(np.array([texts[x] for x in some]) / sum(texts.values()))))
    return models


def score_texts(texts: list[str | None], langs: list[str], log_p: np.ndarray, prior: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Best language of each text (None: no letter), its log-score, and the log of the sum of all scores."""
    runs = [letter_runs(t or "") for t in texts]
    total = np.tile(prior, (len(texts), 1))
    for a, b in chunks([len(x) for x in runs], CHUNK):
        parts = [(k, g) for k in range(a, b) for g in bucket_parts(runs[k], ORDERS, BITS, CHUNK)]
        for c, d in chunks([len(g) for _, g in parts], len(ORDERS) * CHUNK):
            starts = np.r_[0, np.cumsum([len(g) for _, g in parts[c:d]])[:-1]]
            sums = np.add.reduceat(log_p[np.concatenate([g for _, g in parts[c:d]])], starts, axis=0, dtype=np.float64)
            np.add.at(total, [k for k, _ in parts[c:d]], sums)
    best = total.argmax(1)
    top = total[np.arange(len(total)), best]
    return [langs[k] if len(x) else None for k, x in zip(best, runs)], top, top + np.log(np.exp(total - top[:, None]).sum(1))


def _scorer(shared: Broadcast):
    """A function of texts for the model of one block."""

    @F.arrow_udf("struct<lang: string, top: double, all: double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [score_texts(batch.slice(a, 500).to_pylist(), *shared.value) for a in range(0, len(batch), 500)]
            names = pa.array([x for p in parts for x in p[0]], pa.string())
            yield pa.StructArray.from_arrays([names, *(pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.float64()) for k in (1, 2))], ["lang", "top", "all"])

    return scored


def predict(df: DataFrame, models: list[Model], text_col: str = "text", out_col: str = "language") -> DataFrame:
    """Adds a struct ``(lang_pred, score)``."""
    bound_batches(df)
    found = [_scorer(df.sparkSession.sparkContext.broadcast(model))(F.col(text_col)) for model in models]
    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not found:
        return df.withColumn(out_col, unknown)
    each = fresh(df, "blocks")
    out = df.withColumn(each, F.array(*found))
    best = F.aggregate(F.slice(each, 2, len(found)), F.get(each, F.lit(0)), lambda a, b: F.when(b["top"] > a["top"], b).otherwise(a))  # equal: the first by name
    share = F.aggregate(each, F.lit(0.0), lambda a, b: a + F.exp(b["all"] - best["top"]))
    return out.withColumn(out_col, F.when(best["lang"].isNull(), unknown).otherwise(F.struct(best["lang"].alias("lang_pred"), (1 / share).alias("score")))).drop(each)


def language_predictions(documents: DataFrame) -> DataFrame:
    """Trains on four fifths of the rows and predicts all (the contract of ``op4``)."""
    held_out = fold("doc_id", 5) == 0
    models = train(documents.where(~held_out))
    out = predict(documents.select("doc_id", "text", held_out.alias("held_out")), models)
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score")
