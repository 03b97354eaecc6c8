"""Classifiers against small ones in numpy: terms, vectors, fits, fusion, cuts, thresholds, pairs of sources."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from letterspark.operators import classify as M

rng = random.Random(5)
GOOD, BAD = "alpha beta gamma delta house".split(), "omega sigma gamma house win".split()
TEXTS = [" ".join(rng.choice(BAD if k % 3 == 0 else GOOD) for _ in range(rng.randint(3, 12))) for k in range(90)] + ["", None, "unseen words only", "x", "ALPHA Alpha, beta"]
LABELS = [int(k % 3 == 0) for k in range(90)] + [None] * 5


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, y, int(k % 2 == 0)) for k, (t, y) in enumerate(zip(TEXTS, LABELS))], "id int, text string, y int, even int")


def terms(t):
    w = re.findall(r"\w{2,}", (t or "").lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


@pytest.fixture(scope="module")
def expected():
    df = Counter(x for t in TEXTS for x in set(terms(t)))
    names = sorted(x for x, n in df.items() if n >= 2)
    idf = np.array([math.log((1 + len(TEXTS)) / (1 + df[x])) + 1 for x in names])
    x = np.zeros((len(TEXTS), len(names)))
    for i, t in enumerate(TEXTS):
        for term, n in Counter(terms(t)).items():
            if term in names:
                x[i, names.index(term)] = (1 + math.log(n)) * idf[names.index(term)]
        x[i] /= np.linalg.norm(x[i]) or 1
    return names, x


@pytest.fixture(scope="module")
def vectors(docs):
    return M.text_vectors(docs, "id", "text", M.vocabulary(docs, "id", "text"), "y", "even")


def test_vocabulary_and_vectors(spark, docs, vectors, expected):
    names, x = expected
    assert [r.term for r in M.vocabulary(docs, "id", "text").orderBy("place").collect()] == names
    assert M.vocabulary(docs, "id", "text", most=3).count() == 3
    got = {r.id: r.features.toArray() for r in vectors.collect()}
    assert np.allclose([got[k] for k in range(len(TEXTS))], x)


def test_predictions_equal_a_small_fit(vectors, expected):
    _, x = expected
    known = np.array([y is not None for y in LABELS])
    w = M.logistic(x[known], np.array([y for y in LABELS if y is not None], float), strength=10.0)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    got = {r.id: r.p for r in M.probability(M.fit_linear(vectors, "y", strength=10.0), vectors, "p").collect()}
    assert np.allclose([got[k] for k in range(len(TEXTS))], p, atol=2e-4)


def test_systems_fusion_and_cuts(spark, docs):
    rows = spark.createDataFrame([(k, k % 7 + (10 if y else 0), k % 5, y) for k, y in enumerate(LABELS[:90])] + [(99, None, None, 0)], "id int, a int, b int, y int")
    systems = M.fit_systems(rows, "y", {"one": ["a"], "two": ["b"]})
    scored = M.system_scores(rows, systems, {"both": ("one", "two")})
    r = scored.where("id < 90").toPandas()
    assert np.allclose(r["both"], (r.one + r.two) / 2) and r[r.y == 1].one.min() > r[r.y == 0].one.max()
    cuts = M.matched_cuts(scored, ["one", "two", "both"], "y", 0.1)
    table = {x.system: x for x in M.flag_table(scored, cuts, "y").collect()}
    assert all(t.alarms <= 0.1 * t.negatives and t.negatives == 61 for t in table.values()) and table["one"].caught == table["one"].positives == 30


def test_one_threshold_a_label(spark, vectors):
    scored = M.label_probabilities(vectors.where("id % 4 > 0"), vectors.where("id % 4 = 0"), "id", ["y", "even"])
    cuts = {r.label: r.threshold for r in M.label_thresholds(scored, 5).collect()}
    right = scored.where("label = 'y' and y is not null").where((F.col("p") >= cuts["y"]) == (F.col("y") == 1)).count()
    assert set(cuts) == {"y", "even"} and right >= 0.9 * scored.where("label = 'y' and y is not null").count()
    assert {r.threshold for r in M.label_thresholds(scored, 1000).collect()} == {0.5}


def test_separability_equals_brute_force(spark):
    rows = []
    for k in range(240):
        s = "abc"[k % 3]
        rows.append((k, s, "k", k % 4 > 0, [rng.gauss({"a": 0, "b": 0.2, "c": 3}[s], 1), rng.gauss(0, 1)]))
    rows.append((999, None, "k", True, [0.0, 0.0]))
    df = spark.createDataFrame(rows, "id int, s string, kind string, train boolean, x array<double>")
    got = {(r.a, r.b): r for r in M.separability(df, "s", "kind", F.col("train"), "x", "id").collect()}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        part = [r for r in rows if r[1] in (a, b)]
        w = M.logistic(np.array([r[4] for r in part if r[3]]), np.array([float(r[1] == b) for r in part if r[3]]))
        score = {r[0]: np.dot(r[4], w[:-1]) + w[-1] for r in part if not r[3]}
        pos, neg = ([score[r[0]] for r in part if not r[3] and r[1] == x] for x in (b, a))
        auc = np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])
        r = got[a, b]
        assert abs(r.auc - auc) < 1e-6 and (r.n_train_a, r.n_test_a) == (60, 20)
    assert len(got) == 3 and got["a", "c"].auc > 0.95
    capped = M.separability(df, "s", "kind", F.col("train"), "x", "id", cap=10).first()
    assert (capped.n_train_a, capped.n_train_b, capped.n_test_a) == (10, 10, 20)
