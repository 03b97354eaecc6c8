"""Linear classifiers on text and on feature columns, distributed: terms, sparse vectors, weighted fits, fusion, cuts and thresholds.

Terms (single words and pairs of neighbours) are counted over all texts; the vocabulary is a table, joined to the terms of
each text. Vectors are made by expressions only: struct and vector share one Parquet layout, so a table of structs is read
back as sparse vectors. Fits are those of ``pyspark.ml``, with the strength of the penalty per row, as usual elsewhere.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from letterspark.functions.text import bind
from letterspark.operators.evaluate import matched_cut, tune_threshold, weighted_auc
from letterspark.plans.shared import stored

#: Terms of a vocabulary, and texts that a term must stand in.
MOST_TERMS, LEAST_TEXTS = 200_000, 2
#: Characters of texts in a task that makes vectors.
PART = 8_000_000


def terms_of(text: Column, pairs: bool = True) -> Column:
    """Words of two letters or digits or more, in lower case, then pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    if not pairs:
        return words
    both = F.transform(F.array(words), lambda w: F.concat(w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))))
    return F.get(both, F.lit(0))


def counted(terms: Column) -> Column:
    """``(term, n)`` of each different term of an array, by name: counted in the row, so that no table of all texts' terms is held or shuffled."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bind(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("n"))))

    none = F.array().cast("array<struct<term: string, n: int>>")
    return bind(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))


def term_counts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, n)`` of texts, one row a key."""
    return documents.select(key, F.explode(counted(terms_of(F.col(text)))).alias("t")).select(key, "t.term", "t.n")


def vocabulary(documents: DataFrame, key: str, text: str, least: int = LEAST_TEXTS, most: int = MOST_TERMS) -> DataFrame:
    """``(term, place, idf)`` of terms in ``least`` texts or more, at most ``most`` of them: those that occur most, then by name."""
    n = documents.select(key).distinct().count()
    counts = term_counts(documents, key, text).groupBy("term").agg(F.count("*").alias("texts"), F.sum("n").alias("all")).where(F.col("texts") >= least)
    kept = counts.orderBy(F.desc("all"), "term").limit(most)
    place = F.row_number().over(Window.orderBy("term")) - 1  # over the vocabulary, which ``most`` bounds
    return stored(kept.select("term", place.alias("place"), (F.log((1.0 + n) / (1 + F.col("texts"))) + 1).alias("idf")))


def text_vectors(documents: DataFrame, key: str, text: str, terms: DataFrame, *keep: str) -> DataFrame:
    """``(key, *keep, features)``: sublinear counts times idf, of length one; a text without known terms has an empty vector. One row a key.

    Texts are dealt by key once, ``PART`` characters or so to a task; their terms are then counted, weighted and put together
    where they stand.
    """
    size = terms.count()
    parts = max(documents.sparkSession.sparkContext.defaultParallelism, -(-(documents.agg(F.sum(F.length(text))).first()[0] or 0) // PART))
    known = F.broadcast(terms) if size <= MOST_TERMS else terms
    dealt = documents.select(key, *keep, text).repartition(parts, key).select(key, *keep, F.explode_outer(counted(terms_of(F.col(text)))).alias("t")).select(key, *keep, "t.term", "t.n")
    weighted = dealt.join(known, "term", "left").select(key, *keep, "place", ((1 + F.log("n")) * F.col("idf")).alias("v"))
    entry = F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "v"))))
    rows = weighted.groupBy(key, *keep).agg(entry.alias("e"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.transform("e", lambda x: x["place"]).alias("indices"), F.transform("e", lambda x: x["v"] / F.col("norm")).alias("values"),
    )
    made = rows.select(key, *keep, vector.alias("features"))
    return stored(made, StructType([*made.schema.fields[:-1], StructField("features", VectorUDT())]))


def balanced(label: str, rows: DataFrame) -> Column:
    """Weight of a row so that both classes weigh the same."""
    n = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # two rows
    total = sum(n.values())
    return reduce(lambda c, y: c.when(F.col(label) == y, F.lit(total / (len(n) * n[y]))), list(n)[1:], F.when(F.col(label) == list(n)[0], F.lit(total / (len(n) * n[list(n)[0]]))))


def fit_linear(rows: DataFrame, label: str, features: str = "features", strength: float = 1.0, weighted: bool = False, rounds: int = 200) -> LogisticRegressionModel:
    """Logistic regression on vectors as they are; ``strength`` is the inverse penalty of all rows together, null labels don't train."""
    # each round adds up a gradient from every partition: their number must not grow with the input
    rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    rows = rows.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double"))
    rows = rows.withColumn("_w", balanced("_y", rows) if weighted else F.lit(1.0))
    model = LogisticRegression(featuresCol=features, labelCol="_y", weightCol="_w", standardization=False, regParam=1 / (strength * rows.count()), maxIter=rounds, tol=1e-9)
    return model.fit(rows)


def probability(model: LogisticRegressionModel, rows: DataFrame, out: str) -> DataFrame:
    """``rows`` with the probability of class 1."""
    cols = [c for c in rows.columns if c != out]
    done = model.copy({model.probabilityCol: "_p", model.rawPredictionCol: "_r", model.predictionCol: "_c"}).transform(rows)
    return done.select(*cols, vector_to_array("_p")[1].alias(out))


# ---------------------------------------------------------------- feature groups
System = tuple[list[str], StandardScalerModel, LogisticRegressionModel]


def _assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="_raw").transform(rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names}))


def fit_systems(train: DataFrame, label: str, groups: dict[str, list[str]]) -> dict[str, System]:
    """For each group of columns a scaler and a balanced fit; a null feature counts 0."""
    out = {}
    for name, columns in groups.items():
        rows = _assembled(train, columns)
        scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(rows)
        out[name] = columns, scaler, fit_linear(scaler.transform(rows), label, weighted=True, rounds=500)
    return out


def system_scores(rows: DataFrame, systems: dict[str, System], fused: dict[str, tuple[str, ...]]) -> DataFrame:
    """``rows`` with a score column for each system, and for each fusion the mean of its systems' scores."""
    keep = rows.columns
    for name, (columns, scaler, model) in systems.items():
        keep = [*keep, name]
        scored = probability(model, scaler.transform(_assembled(rows.withColumns({f"_f_{c}": F.col(c) for c in columns}), [f"_f_{c}" for c in columns])), name)
        rows = scored.select(*keep)
    return rows.withColumns({k: sum((F.col(c) for c in some), F.lit(0.0)) / len(some) for k, some in fused.items()})


def matched_cuts(validation: DataFrame, systems: list[str], label: str, rate: float) -> dict[str, float]:
    """For each system the cut above which at most ``rate`` of the validation negatives lie."""
    found = {s: matched_cut(validation.select(s, label), s, F.col(label) == 1, rate).first() for s in systems}
    return {s: float("inf") if r is None or r["cut"] is None else r["cut"] for s, r in found.items()}


def flag_table(test: DataFrame, cuts: dict[str, float], label: str) -> DataFrame:
    """``(system, cut, caught, positives, alarms, negatives)`` on held-out rows."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.lit(c).alias("cut"), (F.col(s) > c).alias("hit")) for s, c in cuts.items()))).alias("x")
    y, hit = F.col("y") == 1, F.col("x.hit")
    return test.select(F.col(label).alias("y"), each).where("y is not null").groupBy("x.system", "x.cut").agg(F.count_if(y & hit).alias("caught"), F.count_if(y).alias("positives"), F.count_if(~y & hit).alias("alarms"), F.count_if(~y).alias("negatives"))


# ---------------------------------------------------------------- several labels
def label_probabilities(train: DataFrame, others: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """``(key, label, y, p)`` of the other rows, in long form: one weighted fit a label on its rows with a value, all on one set of vectors."""
    train = train.persist()
    out = None
    for name in labels:
        model = fit_linear(train.select("features", name), name, weighted=True)
        part = probability(model, others.select(key, "features", F.col(name).alias("y")), "p").select(key, F.lit(name).alias("label"), "y", "p")
        out = part if out is None else out.unionByName(part)
    return out


def label_thresholds(scored: DataFrame, least: int = 10) -> DataFrame:
    """``(label, threshold)``: the best of the grid on validation rows; a half for labels with fewer than ``least`` positives."""
    known = scored.where("y is not null")
    enough = known.groupBy("label").agg((F.count_if(F.col("y") == 1) >= least).alias("enough"))
    tuned = tune_threshold(known, "label", F.col("p"), F.col("y") == 1).select("label", "threshold")
    return enough.join(tuned, "label").select("label", F.when(F.col("enough"), F.col("threshold")).otherwise(0.5).alias("threshold"))


# ---------------------------------------------------------------- pairs of collections
def logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a small logistic regression (the last is the intercept, which isn't penalised), by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1] - 1, 1 / strength), 0.0]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.lstsq((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w, rcond=None)[0]
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def hashed_words(text: Column, size: int) -> Column:
    """Share of a text's words in each of ``size`` hash buckets."""
    place = F.transform(terms_of(text, pairs=False), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    share = lambda at, k: F.size(F.filter(at, lambda a: a == k)) / F.greatest(F.size(at), F.lit(1))
    return F.get(F.transform(F.array(place), lambda at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: share(at, k))), F.lit(0))


def separability(rows: DataFrame, source: str, kind: str, train: Column, features: str, key: str, cap: int = 3000) -> DataFrame:
    """``(a, b, n_train_a, n_train_b, n_test_a, n_test_b, auc)`` of every two sources of one kind: how well a classifier tells them apart.

    Vectors (arrays) are made once. Training rows, the first ``cap`` of a source in hash order (a parameter of the survey), go to the
    pairs of their source; each pair is a small fit of its own. Test rows, all of them, meet only the weights, and the areas are
    exact sums over ranges of scores.
    """
    rows = stored(rows.where(F.col(source).isNotNull()).select(key, F.col(source).alias("s"), F.col(kind).alias("kind"), F.coalesce(train, F.lit(False)).alias("train"), F.col(features).cast("array<double>").alias("x")))
    names = rows.select("s", "kind").distinct()
    pairs = names.select("kind", F.col("s").alias("a")).join(names.select("kind", F.col("s").alias("b")), "kind").where("a < b").withColumn("pair", F.concat_ws("|", "kind", "a", "b"))
    side = pairs.select("kind", "pair", F.explode(F.array(F.struct(F.col("a").alias("s"), F.lit(0).alias("y")), F.struct(F.col("b").alias("s"), F.lit(1).alias("y")))).alias("o")).select("kind", "pair", "o.*")
    order = Window.partitionBy("s", "kind").orderBy(F.xxhash64(key), key)
    some = rows.where("train").withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= cap)

    def fit(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["y", key])
        w = logistic(np.stack(table.x.to_numpy()), table.y.to_numpy(float)) if table.y.nunique() == 2 else None
        return pd.DataFrame({"pair": [table.pair.iloc[0]], "w": [None if w is None else w.tolist()]})

    weights = some.join(side, ["s", "kind"]).select("pair", "y", key, "x").groupBy("pair").applyInPandas(fit, "pair string, w array<double>")
    dot = F.aggregate(F.zip_with("x", "w", lambda a, b: F.coalesce(a, F.lit(1.0)) * b), F.lit(0.0), lambda a, b: a + b)  # the last weight stands alone
    scored = rows.where("not train").join(side, ["s", "kind"]).join(weights, "pair").where("w is not null").select("pair", "y", F.round(dot, 9).alias("score"))
    auc = weighted_auc(scored, "pair", "score", F.col("y") == 1)
    n = rows.groupBy("s", "kind").agg(F.least(F.count_if("train"), F.lit(cap)).alias("n_train"), F.count_if(~F.col("train")).alias("n_test"))
    for name in ("a", "b"):
        pairs = pairs.join(n.select(F.col("s").alias(name), "kind", F.col("n_train").alias(f"n_train_{name}"), F.col("n_test").alias(f"n_test_{name}")), [name, "kind"])
    return pairs.join(auc, "pair", "left").select("kind", "a", "b", "n_train_a", "n_train_b", "n_test_a", "n_test_b", "auc")
