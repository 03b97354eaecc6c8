"""Leakage-safe splits and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterspark.plans.prefix import join_on, running_sum
from letterspark.plans.shared import cut


def subject_of(headers: Column) -> Column:
    """Subject with folded lines joined and white space squeezed."""
    found = F.regexp_extract(headers, r"(?i)(?:^|\n)Subject:([^\n]*(?:\n[ \t][^\n]*)*)", 1)
    return F.trim(F.regexp_replace(found, r"[ \t\r\n]+", " "))


def thread_key(subject: Column) -> Column:
    """Letters and digits of the subject without reply and forward prefixes."""
    bare = F.regexp_replace(F.lower(subject), r"^[ ]*(?:(?:re|fw|fwd|aw|sv|antw)[ ]*(?:\[[0-9]+\])?[ ]*:[ ]*)+", "")
    return F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "")


def group_key(subject: Column, row: Column) -> Column:
    key = thread_key(subject)
    return F.when(F.length(key) > 0, F.concat(F.lit("t:"), key)).otherwise(F.concat(F.lit("r:"), row.cast("string")))


def position(key: Column, seed: str = "1") -> Column:
    """Place of a key in [0, 1): the first 15 hex digits of SHA-256(seed|key)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256), 1, 15), 16, 10).cast("long") / F.lit(float(16**15))


def modulo_bucket(key: Column, n: int = 100) -> Column:
    """The whole 256-bit hash of a key modulo ``n``, digit by digit."""
    digits = F.transform(F.split(F.sha2(key.cast("string"), 256), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda acc, d: (acc * 16 + d) % n)


def pick(tag: str, key: Column, options: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), modulo_bucket(F.concat(F.lit(f"{tag}|"), key.cast("string")), len(options)) + 1)


def break_up_groups(df: DataFrame, stratum: str, group: str, row: str, share: float = 0.02, least: int = 25) -> DataFrame:
    """Rows of groups larger than max(share of the stratum, least) become groups of their own. ``df`` is read three times: cut its lineage before where it is dear."""
    sizes = df.groupBy(stratum, group).agg(F.count("*").alias("_g"))
    totals = sizes.groupBy(stratum).agg(F.sum("_g").alias("_s"))
    big = join_on(sizes, totals, [stratum]).where(F.col("_g") > F.greatest(F.col("_s") * share, F.lit(float(least)))).select(stratum, group, F.lit(True).alias("_big"))
    out = join_on(df, big, [stratum, group], "left")
    return out.withColumn(group, F.when(F.col("_big"), F.concat(F.lit("r:"), F.col(row).cast("string"))).otherwise(F.col(group))).drop("_big")


def clusters(df: DataFrame, sizes: DataFrame, stratum: str, group: str, row: str, share: float = 0.02, least: int = 25) -> DataFrame:
    """Resampling units of one split: groups, broken up like ``break_up_groups`` by the sizes ``(stratum, n)`` of the strata in all splits."""
    own = df.groupBy(stratum, group).agg(F.count("*").alias("_g"))
    big = join_on(own, sizes, [stratum]).where(F.col("_g") > F.greatest(F.col("n") * share, F.lit(float(least)))).select(stratum, group, F.lit(True).alias("_big"))
    out = join_on(df, big, [stratum, group], "left")
    return out.withColumn(group, F.when(F.col("_big"), F.concat(F.lit("r:"), F.col(row).cast("string"))).otherwise(F.col(group))).drop("_big")


def assign_splits(df: DataFrame, stratum: str, group: str, seed: str = "1") -> DataFrame:
    """70/15/15 by the middle of each whole group in hash order inside its stratum, in integers. A null stratum or group is one like any other."""
    groups = df.groupBy(stratum, group).agg(F.count("*").alias("_n")).withColumn("_pos", position(F.col(group), seed))
    groups = cut(groups)  # read for ranges, sums and totals
    placed = running_sum(groups, [stratum], "_pos", "_n", "_done", group)
    total = groups.groupBy(stratum).agg(F.sum("_n").alias("_total"))
    twice = 10 * (2 * F.col("_done") + F.col("_n"))
    placed = join_on(placed, total, [stratum]).withColumn("split", F.when(twice < 14 * F.col("_total"), "train").when(twice < 17 * F.col("_total"), "validation").otherwise("test"))
    return join_on(df, placed.select(stratum, group, "split"), [stratum, group])


def straddling_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups in more than one split; must be empty for groups of one stratum."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("n")).where("n > 1")


def split_report(df: DataFrame, stratum: str) -> DataFrame:
    counts = df.groupBy(stratum, "split").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(stratum)), 4))


def draw(df: DataFrame, strata: list[str], quota: DataFrame, row: str, seed: str = "1") -> DataFrame:
    """The first ``n`` rows (column of ``quota``) of each stratum in hash order; rows of strata without a quota are left out.

    Ranks come from range sums, so no window holds a whole stratum.
    """
    placed = df.withColumn("_pos", position(F.col(row), seed)).withColumn("_one", F.lit(1)).join(quota, strata)
    placed = running_sum(placed, strata, "_pos", "_one", "_before", row)
    return placed.where("_before < n").withColumn("_rank", (F.col("_before") + 1).cast("int")).drop("_pos", "_one", "_before", "n")


def shortages(df: DataFrame, strata: list[str], quota: DataFrame) -> DataFrame:
    have = df.groupBy(*strata).agg(F.count("*").alias("eligible"))
    return quota.join(have, strata, "left").select(*strata, "n", F.coalesce("eligible", F.lit(0)).alias("eligible"), F.greatest(F.lit(0), F.col("n") - F.coalesce("eligible", F.lit(0))).alias("short"))


def capped_draw(df: DataFrame, by: str, cap: int, row: str, seed: str = "1") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(row).cast("string")), 256)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def proportional_quota(df: DataFrame, by: str, total: int, floor: int, cap: int) -> DataFrame:
    """Shares of ``total``, rounded half to even, between a floor and a cap."""
    n = df.groupBy(by).agg(F.count("*").alias("size"))
    whole = n.agg(F.sum("size").alias("all"))
    return n.crossJoin(F.broadcast(whole)).select(by, "size", F.least(F.col("size"), F.lit(cap), F.greatest(F.lit(floor), F.bround(total * F.col("size") / F.col("all")))).cast("long").alias("quota"))


def assign_batches(df: DataFrame, row: str, size: int, seed: str = "1") -> DataFrame:
    """Shuffles rows by hash into batches of ``size`` with local numbers; ranks come from range sums."""
    placed = df.withColumn("_pos", position(F.col(row), seed)).withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0))
    placed = running_sum(placed, ["_all"], "_pos", "_one", "_rank", row)
    batch = F.concat(F.lit("b"), F.lpad((F.floor(F.col("_rank") / size) + 1).cast("string"), 4, "0"))
    return placed.withColumn("batch", batch).withColumn("local_id", (F.col("_rank") % size + 1).cast("long")).drop("_pos", "_one", "_all", "_rank")


def seeded_limit(df: DataFrame, row: str, n: int, seed: str = "1") -> DataFrame:
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(row).cast("string")), 256)).limit(n)
