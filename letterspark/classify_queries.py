"""Queries over learned comparisons, in the registry of ``letterspark.queries``; fits have no SQL and are tested against small ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from letterspark.functions.text import has_link, word_count
from letterspark.operators import classify as M
from letterspark.operators import splits as C
from letterspark.operators.evaluate import confusion
from letterspark.queries import query

col = F.col


def _split(key: str = "doc_id"):
    at = C.position(col(key))
    return F.when(at < 0.7, "train").when(at < 0.85, "validation").otherwise("test")


def _documents(t):
    labels = t("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    return t("documents").where("doc_id is not null").dropDuplicates(["doc_id"]).join(labels, "doc_id", "left").withColumn("split", _split())


@query()
def l11_systems(t):
    text, n = col("text"), F.greatest(F.length("text"), F.lit(1))
    rows = _documents(t).select(
        "doc_id", "toxic", "split", word_count(text).alias("words"), has_link(text).cast("int").alias("link"), (F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / n).alias("capitals"), (F.length(F.regexp_replace("text", "[^!?]", "")) / n).alias("signs"),
        (col("lang") == "en").cast("int").alias("english"), F.length("source").alias("source_length"), (col("n_chars") > 1000).cast("int").alias("long"),
    ).where("toxic is not null")
    rows = M.stored(rows)
    systems = M.fit_systems(rows.where("split = 'train'"), "toxic", {"text": ["words", "link", "capitals", "signs"], "source": ["english", "source_length", "long"]})
    scored = M.stored(M.system_scores(rows.where("split <> 'train'"), systems, {"fusion": ("text", "source")}))
    cuts = M.matched_cuts(scored.where("split = 'validation'"), ["text", "source", "fusion"], "toxic", 0.05)
    return M.flag_table(scored.where("split = 'test'"), cuts, "toxic").withColumn("cut", F.round("cut", 6))


def _vectors(t, *keep):
    rows = M.stored(_documents(t))  # read three times
    terms = M.vocabulary(rows.where("split = 'train'"), "doc_id", "text")
    return M.text_vectors(rows, "doc_id", "text", terms, "split", *keep)


@query()
def l12_text_classifier(t):
    rows = _vectors(t, "toxic")
    model = M.fit_linear(rows.where("split = 'train'"), "toxic", strength=10.0)
    return M.probability(model, rows.select("doc_id", "split", "features"), "p").withColumn("p", F.round("p", 6))


@query()
def l23_multi_label(t):
    rows = _vectors(t, "toxic", "quality")
    scored = M.stored(M.label_probabilities(rows.where("split = 'train'"), rows.where("split <> 'train'"), "doc_id", ["toxic", "quality"]).join(rows.select("doc_id", "split"), "doc_id"))
    cuts = M.label_thresholds(scored.where("split = 'validation'"))
    test = scored.where("split = 'test' and y is not null").join(F.broadcast(cuts), "label")  # one row a label
    return confusion(test, ["label", "threshold"], col("y") == 1, col("p") >= col("threshold"))


@query()
def l16_separability(t):
    rows = _documents(t).select("doc_id", "source", F.lit("all").alias("kind"), "split", M.hashed_words(col("text"), 64).alias("x"))
    return M.separability(rows, "source", "kind", col("split") == "train", "x", "doc_id")
