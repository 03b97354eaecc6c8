"""Answers of annotators: validity, latest answers, spans, counts and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def span_in(span: Column, text: Column) -> Column:
    """Whether the words of a span stand in a row in the text."""
    pad = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    return F.contains(pad(text), pad(span))


def spans_overlap(a: Column, b: Column) -> Column:
    """One holds the other, or their sets of words have a Jaccard index of a half or more."""
    x, y = words(a), words(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return span_in(a, b) | span_in(b, a) | F.when(either > 0, both / either >= 0.5).otherwise(False)


def latest_valid(answers: DataFrame, item: str, order: str, valid: Column, value: str) -> DataFrame:
    """The last valid answer of each item, and how many were refused; NULL while the item is open."""
    return answers.groupBy(item).agg(F.max_by(F.when(valid, F.col(value)), F.when(valid, F.col(order))).alias("answer"), F.count_if(~valid).alias("refused"))


def positive_counts(df: DataFrame, label: str, keys: tuple[str, str], rare: int = 10) -> DataFrame:
    """Positives for all and by each key, with a flag on rare ones."""
    a, b = keys
    g = df.groupingSets([[], [a], [b]], a, b).agg(F.sum(label).alias("positives"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    scope = F.when(F.col("ga") == 0, F.concat(F.lit(f"{a}:"), a)).when(F.col("gb") == 0, F.concat(F.lit(f"{b}:"), b)).otherwise("all")
    return g.select(scope.alias("scope"), "positives", (F.col("positives") < rare).alias("rare"))


def class_weights(df: DataFrame, by: str, label: str, cap: float) -> DataFrame:
    """Negatives for each positive, at most ``cap``; the cap where there are no positives."""
    n = df.groupBy(by).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return n.withColumn("weight", F.when(F.col("pos") > 0, F.least(F.lit(cap), F.round(F.col("neg") / F.col("pos"), 6))).otherwise(cap))


def confusion_pairs(df: DataFrame, item: str, label: str, truth: Column, predicted: Column) -> DataFrame:
    """How often a label was missed on an item that another label was given to wrongly."""
    missed = df.where(truth & ~predicted).select(item, F.col(label).alias("missed")).distinct()
    wrong = df.where(~truth & predicted).select(item, F.col(label).alias("given")).distinct()
    return missed.join(wrong, item).groupBy("missed", "given").agg(F.count("*").alias("n"))
