"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of orders 1 to ``ORDER`` with a uniform one:
P_k(w | h) = m ML_k(w | h) + (1 - m) P_(k-1)(w | shorter h), where the weight m depends on
the order and on the bucket of the history's frequency (its number of binary digits).
Weights come from expectation-maximisation on the n-grams of the tuning part of the
training rows, with that part deleted from the counts that estimate them; the counts of all
training rows give the scores.

Counts are those of all n-grams of all training rows and grow with them: no vocabulary is
cut and no table of n-grams is broadcast. Blocks of texts ask for the sums of their distinct
n-grams, one shuffle of packed arrays an order (``text_blocks``), and score their own
documents from the answers. An n-gram's key is a 64-bit fingerprint; equal ones are taken
as equal. For a weight only the ratio ML_k : P_(k-1) counts, so what EM reads is a table of
cells (bucket, eighths of an octave of the ratio) of at most 65 x 1,026 rows an order.

Defined results: a null text is empty and has one token, the end. Words are runs of
characters but blanks, A-Z lower-case; a history that begins before the text is padded.
Without training rows every token has the uniform probability. A bucket without tuning
tokens takes the weight of the nearest one below, else above; without any, one half. A null
id counts as an empty string in the fold. Repeated rows count as often as they occur and
each gets its score. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from letterspark.llm.common import publish
from letterspark.llm.language_id import fold
from letterspark.llm.text_blocks import Words, counts_of, exchange, gram_hashes, text_blocks, with_answers

ORDER = 3
ADDED = 0.1
ROUNDS = 100
#: Steps of an octave, and octaves, of the ratios that EM reads.
STEPS, OCTAVES = 8, 64
#: No weight is larger, so that no word is impossible.
MOST = 1 - 1e-6
_START, _END = np.uint64(0x51A7), np.uint64(0xE0D)
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1


class Sizes(NamedTuple):
    """Of the training rows and of their tuning part: tokens and documents; and the distinct tokens."""

    tokens: tuple[int, int]
    docs: tuple[int, int]
    distinct: int


class Tokens:
    """The tokens of a block: their documents, which of them begin one, and the slots of their n-grams."""

    def __init__(self, row: dict, order: int):
        ends = np.frombuffer(row["ends"], np.int64)
        words = Words(row["data"], ends, _KINDS)
        docs, pad = len(ends), order - 1
        size = np.bincount(words.doc, minlength=docs)
        stop = np.add.accumulate(size + 1 + pad)  # behind each document's end
        self.line = np.full(int(stop[-1]), _START)
        first = stop - size - 1
        self.line[np.arange(len(words)) + (words.doc + 1) * pad + words.doc] = words.hash
        self.line[stop - 1] = _END
        real = np.ones(len(self.line), bool)
        for k in range(pad):
            real[first - 1 - k] = False
        self.at = np.flatnonzero(real)
        self.doc = np.repeat(np.arange(docs), size + 1)
        self.first = np.r_[0, np.add.accumulate(size + 1)[:-1]]
        self.train, self.tune = (np.array(row[name], bool)[self.doc] for name in ("_train", "_tune"))

    def slots(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct prints of the n-grams of ``k`` tokens, ascending, and the place of each token's among them."""
        return np.unique(gram_hashes(self.line, k)[self.at - k + 1], return_inverse=True)

    def asked(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        prints, slot = self.slots(k)
        return prints, np.stack([np.bincount(slot[which], minlength=len(prints)) for which in (self.train, self.tune)])

    def estimates(self, row: dict, sizes: Sizes, order: int, deleted: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each order the count of every token's n-gram, its estimate (0 without history) and the bucket of its history."""
        less = np.array([1, -1 if deleted else 0])
        history = np.full(len(self.at), less @ sizes.tokens)
        for k in range(1, order + 1):
            _, slot = self.slots(k)
            count = (less @ counts_of(row[f"_a{k}"], 2))[slot]
            yield count, np.divide(count, history, out=np.zeros(len(count)), where=history > 0), np.frexp(history.astype(float))[1].astype(np.uint8)
            history = np.r_[0, count[:-1]]
            history[self.first] = less @ sizes.docs


def interpolate(estimates: list[tuple[np.ndarray, np.ndarray]], weights: list[np.ndarray], distinct: int) -> np.ndarray:
    """Probability of each token from its (estimate, bucket) by order."""
    p = np.full(len(estimates[0][0]), 1 / (distinct + 1))
    for (ml, bucket), w in zip(estimates, weights):
        p = w[bucket] * ml + (1 - w[bucket]) * p
    return p


def learn(cells: list[tuple[int, int, int, float]]) -> np.ndarray:
    """Weights of the buckets 0 to 64 from cells (bucket, level, n, sum of binary logarithms): EM on the ratio of estimate to shorter model."""
    n, logs = np.zeros((2, 65, 2 * STEPS * OCTAVES + 2))
    for bucket, level, count, log in cells:
        n[bucket, level] += count
        logs[bucket, level] += log
    ratio = 2.0 ** (logs / np.maximum(1, n))
    ratio[:, 0] = 0
    total, w = n.sum(1), np.full(65, 0.5)
    known = np.flatnonzero(total)
    for _ in range(ROUNDS if len(known) else 0):
        share = w[known, None] * ratio[known]
        w[known] = np.minimum(MOST, (n[known] * (share / (share + 1 - w[known, None]))).sum(1) / total[known])
    if len(known):
        w = w[known[np.maximum(0, np.searchsorted(known, np.arange(65), "right") - 1)]]
    w[0] = 0  # no history
    return w


def levels(ml: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of the ratio (0 for none, else eighths of octaves from 1) and its binary logarithm (0 for none)."""
    log = np.log2(ml / lower, out=np.zeros(len(ml)), where=ml > 0)
    step = np.clip(np.rint(log * STEPS), -STEPS * OCTAVES, STEPS * OCTAVES).astype(np.int64)
    return np.where(ml > 0, step + STEPS * OCTAVES + 1, 0), log


def _cells(evidence: DataFrame, order: int, weights: list[np.ndarray], distinct: int) -> list[tuple[int, int, int, float]]:
    """The cells of the order after those that have weights."""
    k, width = len(weights), 2 * STEPS * OCTAVES + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, logs = np.zeros(65 * width, np.int64), np.zeros(65 * width)
        for batch in batches:
            for ml, bucket in zip(batch.column("ml").to_pylist(), batch.column("bucket").to_pylist()):
                ml, bucket = np.frombuffer(ml, np.float32).reshape(order, -1).astype(float), np.frombuffer(bucket, np.uint8).reshape(order, -1)
                lower = interpolate(list(zip(ml, bucket)), weights, distinct)
                some = bucket[k] > 0
                level, log = levels(ml[k][some], lower[some])
                cell = bucket[k][some].astype(np.int64) * width + level
                sums += np.bincount(cell, minlength=len(sums))
                logs += np.bincount(cell, log, len(logs))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)), pa.array(sums[at]), pa.array(logs[at])], ["bucket", "level", "n", "logs"])

    rows = evidence.mapInArrow(count, "bucket int, level int, n long, logs double").groupBy("bucket", "level").agg(F.sum("n"), F.sum("logs"))
    return sorted(map(tuple, rows.collect()))  # bounded by the cells


def interpolated_scores(df: DataFrame, keys: list[str], train: Column, tune: Column, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Rows ``(*keys, n_tokens, n_known, train_tokens, base_score, score)``, one for each of ``df``.

    ``train`` marks the rows that are learned from, ``tune`` those of them whose n-grams the weights are learned on. Base
    scores are those of unigrams with ``ADDED`` occurrences more each.
    """
    spark = df.sparkSession
    rows = df.select(*keys, F.col(text_col).alias("_text"), train.alias("_train"), (train & tune).alias("_tune"))
    names = [*keys, "_train", "_tune"]
    tuning = publish(text_blocks(rows.where("_tune"), "_text", names))
    others = publish(text_blocks(rows.where("not _tune"), "_text", names, 1 << 62))
    blocks = tuning.unionByName(others)

    def totals(sums: np.ndarray) -> np.ndarray:
        return np.array([sums[0].sum(), sums[1].sum(), (sums[0] > 0).sum()])

    answers = {}
    for k in range(1, order + 1):
        answers[f"_a{k}"] = publish(exchange(blocks, lambda row, k=k: Tokens(row, order).asked(k), lambda sums: sums, totals if k == 1 else None))
    tokens = sum((np.frombuffer(r.answer, np.int64) for r in answers["_a1"].where("block = -1").select("answer").collect()), np.zeros(3, np.int64))
    docs = blocks.select(*(F.sum(F.size(F.filter(c, lambda x: x))).alias(c) for c in ("_train", "_tune"))).first()
    sizes = Sizes((int(tokens[0]), int(tokens[1])), (docs[0] or 0, docs[1] or 0), int(tokens[2]))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                each = list(Tokens(row, order).estimates(row, sizes, order, True))
                packed = [np.concatenate([e[1] for e in each]).astype(np.float32).tobytes()], [np.concatenate([e[2] for e in each]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.binary()) for p in packed], ["ml", "bucket"])

    seen = publish(with_answers(tuning, **answers).mapInArrow(evidence, "ml binary, bucket binary"))
    weights: list[np.ndarray] = []
    for _ in range(order):
        weights.append(learn(_cells(seen, order, weights, sizes.distinct)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log10(sizes.tokens[0] + ADDED * (sizes.distinct + 1))
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                of = Tokens(row, order)
                each = list(of.estimates(row, sizes, order, False))
                count, sums = each[0][0], lambda x: np.add.reduceat(x, of.first)  # noqa: B023
                p = interpolate([e[1:] for e in each], weights, sizes.distinct)
                columns = [batch.column(c).slice(k, 1).flatten() for c in keys]
                counted = [sums(np.ones(len(count), np.int64)), sums((count > 0).astype(np.int64)), np.full(len(of.first), sizes.tokens[0])]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, [*counted, sums(np.log10(count + ADDED) - base), sums(np.log10(p))])], schema.names)

    schema = StructType([*(df.schema[k] for k in keys), *(StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(StructField(c, DoubleType()) for c in ("base_score", "score"))])
    spread = reduce(lambda a, b: a.unionByName(b), (with_answers(part, **answers) for part in (tuning, others)))
    return spread.mapInArrow(score, schema)


def language_model_scores(documents: DataFrame) -> DataFrame:
    """Scores every document (the contract of ``op13``): tenth 0 is held out, tenth 1 of the training rows tunes the weights."""
    rest = fold("doc_id", 10)
    rows = documents.select("doc_id", "text", (rest == 0).alias("held_out"))
    return interpolated_scores(rows, ["doc_id", "held_out"], rest != 0, rest == 1)
