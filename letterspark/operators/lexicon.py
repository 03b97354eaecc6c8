"""Weighted-phrase scoring as joins on the first word."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterspark.functions.text import normalise


#: Phrases of a lexicon, and words of a phrase, at most; bounds what is broadcast.
PHRASES, PHRASE_WORDS = 100_000, 12
#: Names at most that are searched by one expression.
NAMES = 10_000
# Weights of strong and weak phrases.
WEIGHTS = {"strong": 1.0, "weak": 0.5}


def lexicon_problems(lexicon: DataFrame, tactics: tuple[str, ...]) -> DataFrame:
    """``(tactic, phrase, problem)`` of every row that a lexicon may not hold; must be empty."""
    rows = lexicon.select("tactic", "phrase", "strength", normalise(F.col("phrase")).alias("n"))
    rows = rows.withColumn("size", F.size(F.filter(F.split("n", " "), lambda w: w != "")))
    problem = F.when(~F.col("tactic").isin(*tactics), "unknown tactic").when(~F.coalesce(F.col("strength").isin(*WEIGHTS), F.lit(False)), "bad strength").when(F.col("size") == 0, "empty").when(F.col("size") > PHRASE_WORDS, "too long")
    bad = rows.select("tactic", "phrase", problem.alias("problem")).where("problem is not null")
    twice = rows.where("size > 0").groupBy("tactic", "n").agg(F.count("*").alias("c"), F.min("phrase").alias("phrase")).where("c > 1").select("tactic", "phrase", F.lit("duplicate").alias("problem"))
    missing = rows.sparkSession.createDataFrame([(x,) for x in tactics], "tactic string").join(rows, "tactic", "left_anti").select("tactic", F.lit(None).cast("string").alias("phrase"), F.lit("no phrases").alias("problem"))
    return bad.unionByName(twice).unionByName(missing)


def phrase_hits(documents: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, tactic, phrase, weight, start, size)``: each place where a phrase stands, by an equi-join on its first word.

    The lexicon is hand-made and small (checked). Words that begin no phrase are dropped inside the document's array,
    and those that stay carry only the words that the longest phrase needs.
    """
    phrases = lexicon.select("tactic", "phrase", "weight", F.element_at(F.split("phrase", " "), 1).alias("word"), F.size(F.split("phrase", " ")).alias("size"))
    rows = phrases.select("word", "size").limit(PHRASES + 1).collect()
    if len(rows) > PHRASES or any(r.size > PHRASE_WORDS for r in rows):
        raise ValueError(f"a lexicon of over {PHRASES} phrases, or a phrase of over {PHRASE_WORDS} words")
    firsts, longest = sorted({r.word for r in rows}), max((r.size for r in rows), default=1)

    def places(words: Column) -> Column:
        at = F.transform(words, lambda w, i: F.when(w.isin(firsts), i))
        return F.transform(F.array_compact(at), lambda i: F.struct(i.alias("start"), F.get(words, i).alias("word"), F.concat(F.array_join(F.slice(words, i + 1, longest), " "), F.lit(" ")).alias("ahead")))

    words = documents.select(key, F.split(normalise(F.col(text)), " ").alias("words"))
    found = words.select(key, F.explode(F.flatten(F.transform(F.array("words"), places))).alias("p")).select(key, "p.*")
    found = found.join(F.broadcast(phrases), "word").where(F.startswith("ahead", F.concat("phrase", F.lit(" "))))
    return found.select(key, "tactic", "phrase", "weight", "start", "size")


def with_first_phrase(rows: DataFrame, names: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the value (column ``out`` of ``names``) of the phrase that stands first in a text, the longest there, the least value of a phrase with several; NULL without one.

    Texts are searched in their row by one expression, so nothing is shuffled; ``names`` (``phrase, out``) is small (checked).
    """
    value = names.where(F.trim("phrase") != "").groupBy(F.col("phrase").alias("_phrase")).agg(F.min(out).alias(out))
    phrases = [r[0] for r in value.select("_phrase").limit(NAMES + 1).collect()]
    if len(phrases) > NAMES:
        raise ValueError(f"over {NAMES} names")
    some = "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p.split(" ")), p))) or r"(?!x)x"
    found = F.nullif(F.regexp_extract(normalise(F.col(text)), rf"(?:^| )({some})(?= |$)", 1), F.lit(""))
    return rows.withColumn("_phrase", found).join(F.broadcast(value), "_phrase", "left").drop("_phrase")


def tactic_scores(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Longest first, then by place, without overlaps: the sum of the weights of the phrases that keep a place, each once."""
    by = hits.groupBy(key, "tactic").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("n"), "start", "phrase", "weight"))).alias("p"))
    kind = "struct<used: array<struct<a: int, b: int>>, seen: array<string>, score: double>"
    empty = F.struct(F.array().alias("used"), F.array().alias("seen"), F.lit(0.0).alias("score")).cast(kind)

    def take(acc: Column, p: Column) -> Column:
        end = p["start"] - p["n"]
        taken = F.exists(acc["used"], lambda u: (p["start"] < u["b"]) & (end > u["a"]))
        new = ~F.array_contains(acc["seen"], p["phrase"])
        # single words come last and can't cover each other: only longer places are remembered
        used = F.when(p["n"] < -1, F.array_append(acc["used"], F.struct(p["start"].alias("a"), end.alias("b")))).otherwise(acc["used"])
        seen = F.when(new, F.array_append(acc["seen"], p["phrase"])).otherwise(acc["seen"])
        return F.when(taken, acc).otherwise(F.struct(used.alias("used"), seen.alias("seen"), (acc["score"] + F.when(new, p["weight"]).otherwise(0.0)).alias("score"))).cast(kind)

    return by.select(key, "tactic", F.aggregate("p", empty, take)["score"].alias("score"))


def fired(scores: DataFrame, threshold: float | dict[str, float] = 1.0) -> DataFrame:
    """Whether a score reaches the threshold: one for all, or one for each tactic (1 where it is left out)."""
    limit = F.lit(threshold) if not isinstance(threshold, dict) else F.coalesce(*(F.when(F.col("tactic") == k, v) for k, v in threshold.items()), F.lit(1.0))
    return scores.withColumn("fired", F.col("score") >= limit)


def hit_rates(documents: DataFrame, scores: DataFrame, threshold: float = 1.0, key: str = "doc_id") -> DataFrame:
    """Fired and any-hit counts and mean score of each tactic for all, by category and by source.

    Documents without a hit have no rows in ``scores``: their number comes from the counts of each scope.
    """

    def scoped(rows: DataFrame, keys: list[str], *agg: Column) -> DataFrame:
        g = rows.groupingSets([keys, [*keys, "category"], [*keys, "source"]], *keys, "category", "source").agg(*agg, F.grouping("category").alias("gc"), F.grouping("source").alias("gs"))
        scope = F.when((F.col("gc") == 1) & (F.col("gs") == 1), "all").when(F.col("gs") == 1, F.concat(F.lit("category:"), "category")).otherwise(F.concat(F.lit("source:"), "source"))
        return g.withColumn("scope", scope).drop("gc", "gs", "category", "source")

    sizes = scoped(documents.select("category", "source"), [], F.count("*").alias("n"))
    s = F.col("score")
    known = scoped(scores.join(documents.select(key, "category", "source"), key), ["tactic"], F.count_if(s >= threshold).alias("fired"), F.count_if(s > 0).alias("any_hit"), F.sum(s).alias("_sum"))
    tactics = scores.select("tactic").distinct()
    out = sizes.crossJoin(tactics).join(known, ["tactic", "scope"], "left").fillna(0, ["fired", "any_hit", "_sum"])  # scopes and tactics: a few rows
    return out.select("tactic", "scope", "n", "fired", "any_hit", F.round(F.col("_sum") / F.col("n"), 6).alias("mean_score"))


def phrase_table(lexicon: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of each phrase, zero rows too, and its share of its tactic."""
    n = hits.groupBy("tactic", "phrase").agg(F.count_distinct(key).alias("documents"))
    out = lexicon.select("tactic", "phrase", "strength").join(n, ["tactic", "phrase"], "left").fillna(0, ["documents"])
    total = F.sum("documents").over(Window.partitionBy("tactic"))
    return out.withColumn("share", F.when(total > 0, F.round(F.col("documents") / total, 6)))


def sanity_checks(lexicon: DataFrame, hits: DataFrame, documents: DataFrame, key: str = "doc_id", ratio: float = 1.5, cover: float = 0.01, dominant: float = 0.6) -> DataFrame:
    """``(check, tactic, value, status)``: attacks hit more often than other mail, a least share of attacks is hit, and no phrase makes most of a tactic's hits."""
    sides = documents.select(key, F.col("category").isin("phishing", "fraud", "spam").alias("attack"))
    sizes = sides.agg(F.count_if("attack").alias("_a"), F.count_if(~F.col("attack")).alias("_h"))
    n = hits.select("tactic", key).distinct().join(sides, key).groupBy("tactic").agg(F.count_if("attack").alias("a"), F.count_if(~F.col("attack")).alias("h"))
    rates = lexicon.select("tactic").distinct().join(n, "tactic", "left").fillna(0, ["a", "h"]).crossJoin(sizes)  # one row of sizes
    rates = rates.select("tactic", (F.col("a") / F.nullif("_a", F.lit(0))).alias("ra"), (F.col("h") / F.nullif("_h", F.lit(0))).alias("rh"))
    top = phrase_table(lexicon, hits, key).groupBy("tactic").agg(F.max("share").alias("v"))
    status = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("status")
    v = F.round(F.col("ra") / F.nullif("rh", F.lit(0.0)), 6)
    return (
        rates.select(F.lit("attack ratio").alias("check"), "tactic", v.alias("value"), status((F.col("ra") > 0) & (F.col("ra") >= ratio * F.col("rh"))))
        .unionByName(rates.select(F.lit("coverage").alias("check"), "tactic", F.round("ra", 6).alias("value"), status(F.col("ra") >= cover)))
        .unionByName(top.select(F.lit("dominant phrase").alias("check"), "tactic", F.col("v").alias("value"), status(F.col("v") <= dominant)))
    )
