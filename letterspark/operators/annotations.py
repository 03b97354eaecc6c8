"""Replies of annotators in batches: items out of prose, their validity, and rules over whole replies; taxonomies and training tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterspark.operators.labels import span_in

ITEM = "array<struct<id: string, labels: map<string, int>, claims: array<struct<type: string, text: string>>>>"
SPAN = 300


def items(replies: DataFrame, batch: str = "batch", reply: str = "reply") -> DataFrame:
    """``(batch, place, id, labels, claims)``: the items of the array that stands inside prose, fences or an object; a reply without one has a single row of nulls."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), ITEM, {"mode": "PERMISSIVE"})
    return replies.select(batch, F.posexplode_outer(found).alias("place", "i")).select(batch, "place", "i.id", "i.labels", "i.claims")


def item_problems(rows: DataFrame, names: tuple[str, ...], types: tuple[str, ...], texts: DataFrame, batch: str = "batch", key: str = "id", text: str = "text") -> DataFrame:
    """``(batch, id, problem)``: keys that aren't the wanted ones, values that aren't 0 or 1, unknown types, spans that are too long or not in the text."""
    wanted = F.array_sort(F.array(*map(F.lit, names)))
    joined = rows.join(texts.select(F.col(key).cast("string").alias("id"), F.col(text).alias("_t")), "id", "left")
    bad = F.array_compact(F.array(
        F.when(F.col("id").isNull(), "no items"), F.when(F.col("labels").isNull() | (F.array_sort(F.map_keys("labels")) != wanted), "keys"),
        F.when(F.exists(F.map_values("labels"), lambda v: v.isNull() | ~v.isin(0, 1)), "values"), F.when(F.exists("claims", lambda c: ~c["type"].isin(*types)), "claim type"),
        F.when(F.exists("claims", lambda c: F.length(c["text"]) > SPAN), "long span"), F.when(F.exists("claims", lambda c: ~span_in(c["text"], F.col("_t"))), "span not in text"),
    ))
    return joined.select(batch, "id", F.explode(bad).alias("problem"))


def reply_problems(rows: DataFrame, expected: DataFrame, batch: str = "batch") -> DataFrame:
    """``(batch, id, problem)`` over whole replies: unknown, repeated and missing ids, and equal answers for all of several items."""
    given = rows.where("id is not null").select(batch, "id", "labels")
    want = expected.select(batch, "id")
    on = [batch, "id"]
    one = given.groupBy(*on).agg(F.count("*").alias("n"))
    answer = F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    same = given.select(batch, answer.alias("a")).groupBy(batch).agg(F.count("*").alias("n"), F.count_distinct("a").alias("d")).where("n > 1 and d = 1")
    return (
        one.join(want, on, "left_anti").select(*on, F.lit("unknown id").alias("problem"))
        .unionByName(one.where("n > 1").select(*on, F.lit("id twice").alias("problem")))
        .unionByName(want.join(one, on, "left_anti").select(*on, F.lit("missing id").alias("problem")))
        .unionByName(same.select(batch, F.lit(None).cast("string").alias("id"), F.lit("equal answers").alias("problem")))
    )


def map_taxonomy(techniques: DataFrame, mapping: DataFrame, targets: tuple[str, ...], key: str) -> DataFrame:
    """One column a target: 1 where a technique of the item maps to it, 0 only where some technique maps to it directly at all (``direct``), else NULL."""
    hit = techniques.join(mapping, "technique").groupBy(key, "target").agg(F.lit(1).alias("y"))
    wide = hit.groupBy(key).pivot("target", list(targets)).agg(F.max("y"))
    # one row: which of the given targets are mapped to directly
    direct = mapping.where(F.col("direct") & F.col("target").isin(*targets)).agg(F.collect_set("target").alias("_direct"))
    out = techniques.select(key).distinct().join(wide, key, "left").crossJoin(F.broadcast(direct))
    return out.select(key, *(F.coalesce(F.col(x), F.when(F.array_contains("_direct", x), 0)).alias(x) for x in targets))


def pair_problems(pairs: DataFrame, least: int = 20, most: int = 400) -> DataFrame:
    """``(pair, side, problem)`` of pairs ``(pair, side, text, wanted, found, fired)``: word range, links, required claims that weren't found, a twin that fires, equal bodies."""
    n = F.size(F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != ""))
    bad = F.array_compact(F.array(
        F.when(~n.between(least, most), "words"), F.when(F.col("text").rlike(r"(?i)\b(?:https?://|www\.)"), "link"),
        F.when((F.col("side") == "attack") & (F.size(F.array_except("wanted", "found")) > 0), "claims missing"), F.when((F.col("side") == "twin") & F.col("fired"), "twin fires"),
    ))
    one = pairs.select("pair", "side", F.explode(bad).alias("problem"))
    same = pairs.groupBy("pair").agg(F.count("*").alias("n"), F.count_distinct("text").alias("d")).where("n > 1 and d = 1").select("pair", F.lit("both").alias("side"), F.lit("equal bodies").alias("problem"))
    return one.unionByName(same)


def training_checks(df: DataFrame, key: str, labels: tuple[str, ...], split: str) -> DataFrame:
    """``(check, value, status)`` of a training table: unique ids, binary labels, no row of the test split."""

    def row(name: str, value: Column, rows: DataFrame = df) -> DataFrame:
        return rows.agg(value.cast("long").alias("value")).select(F.lit(name).alias("check"), "value", F.when(F.col("value") == 0, "PASS").otherwise("FAIL").alias("status"))

    repeated = df.groupBy(key).agg(F.count("*").alias("n"))
    out = row("repeated ids", F.count_if(F.col("n") > 1), repeated).unionByName(row("test rows", F.count_if(F.col(split) == "test")))
    for name in labels:
        out = out.unionByName(row(f"{name} not binary", F.count_if(~F.coalesce(F.col(name).isin(0, 1), F.lit(False)))))
    return out
