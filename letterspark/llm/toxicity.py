"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of four to six characters that a text holds (present or not),
hashed to 2^18 buckets. A bounded sample of labelled rows gives, for each bucket, the
log ratio of its document frequencies in the two classes; the buckets of largest
evidence keep their ratio as scale, and a logistic regression is fitted on the scaled
features, with each class weighted to its true share. All texts are then scored whole.

``SAMPLE`` is the documented bound of the fit: so many labelled rows of each class, the
first in the order of a hash of their id. Counts and selected features of that sample are
all that reaches the driver. A text's labels, language, source and id are never inputs.

Defined results: null, empty and letterless texts get the score of a text without
features. Null labels don't train; several labels of a document count as their largest.
Without labelled rows of both classes every score is 0. Repeated rows get equal scores.
Other columns are kept; a column with the output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterspark.llm.char_grams import buckets, letter_runs
from letterspark.llm.common import bound_batches, fresh, publish
from letterspark.llm.language_id import fold

ORDERS, BITS = (4, 5, 6), 18
#: Labelled rows of each class in the fit.
SAMPLE = 4000
#: Features that keep a weight.
FEATURES = 1 << 10
ROUNDS, RATE, RIDGE = 200, 0.05, 1e-4
THRESHOLD = 0.7
CHUNK = 1 << 18


def features(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text (only those ``wanted``), in order."""
    x, out = letter_runs(text or ""), []
    reach = ORDERS[-1] - 1
    for a in range(0, len(x), CHUNK):
        found = buckets(x[a : a + CHUNK + reach], ORDERS, BITS)
        out.append(np.unique(found if wanted is None else found[wanted[found]]))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text")):
            sums[y, features(text.as_py())] += 1
    y, at = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[y, at])], ["y", "bucket", "n"])


def fit(labelled: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weight of each bucket and the intercept, from rows ``(text, y, share)``; None without both classes.

    share: rows of the class in all labelled rows for each row of it in the sample.
    """
    spark = labelled.sparkSession
    bound_batches(labelled)
    sizes = {r.y: r for r in labelled.groupBy("y").agg(F.count("*").alias("n"), F.max("share").alias("share")).collect()}
    if len(sizes) < 2:
        return None
    counts = labelled.select("y", "text").mapInArrow(_frequencies, "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((2, 1 << BITS))
    n[counts.column("y").to_numpy(), counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    ratio = np.log((n[1] + 1) / (sizes[1].n + 2)) - np.log((n[0] + 1) / (sizes[0].n + 2))
    evidence = np.abs(ratio) / np.sqrt(1 / (n[1] + 1) + 1 / (n[0] + 1))  # in standard errors
    top = np.argsort(-evidence, kind="stable")[:FEATURES]
    wanted = np.zeros(1 << BITS, bool)
    wanted[top] = True
    shared = spark.sparkContext.broadcast(wanted)

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), shared.value).astype(np.int32).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("_at"), batch.column("y"), batch.column("share"), pa.array(found, pa.list_(pa.int32()))], ["_at", "y", "share", "f"])

    rows = labelled.select("_at", "y", "share", "text").mapInArrow(selected, "_at long, y int, share double, f array<int>").toArrow().sort_by("_at")
    f = rows.column("f").combine_chunks()
    place = np.zeros(1 << BITS, np.int64)
    place[top] = np.arange(len(top))
    feature = place[f.flatten().to_numpy()]
    sample = np.repeat(np.arange(rows.num_rows), f.value_lengths().to_numpy(zero_copy_only=False))
    y, share = rows.column("y").to_numpy().astype(float), rows.column("share").to_numpy()
    scale = ratio[top][feature]
    w, b = np.zeros(len(top)), 0.0
    mean, square = np.zeros(len(top) + 1), np.zeros(len(top) + 1)
    for k in range(1, ROUNDS + 1):
        z = np.bincount(sample, weights=scale * w[feature], minlength=len(y)) + b
        error = share * (1 / (1 + np.exp(-z)) - y) / share.sum()
        slope = np.r_[np.bincount(feature, weights=scale * error[sample], minlength=len(top)) + RIDGE * w, error.sum()]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        step = RATE * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(1 << BITS)
    weights[top] = w * ratio[top]
    return weights, float(b)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Fits on labelled documents whose fold isn't held out."""
    usable = labels.where(fold("doc_id", 3) != 1).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    size = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    chosen = None
    for y, n in sorted(size.items()):
        some = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("share", F.lit(n / min(n, sample)))
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * sample short rows: safe to broadcast at any size of the corpus
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("_at", F.xxhash64("doc_id", "text"))
    return fit(publish(rows.select("_at", "text", "y", "share")))


def score(df: DataFrame, model: tuple[np.ndarray, float] | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds the score, between 0 and 1."""
    if model is None:
        return df.withColumn(out_col, F.lit(0.0))
    bound_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, b = shared.value
        wanted = weights != 0
        for texts in batches:
            z = np.array([weights[features(t.as_py(), wanted)].sum() + b for t in texts])
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), pa.float64())

    return df.withColumn(out_col, scored(F.col(text_col)))


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every document (the contract of ``op6``)."""
    out = score(documents.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out")), train(documents, labels))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, unchanged."""
    name = fresh(documents, "score")
    scored = score(documents, train(documents, labels), out_col=name)
    return scored.where(F.col(name) < THRESHOLD).drop(name)
