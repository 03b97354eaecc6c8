"""Staging, fingerprints and duplicates of labelled messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(text: Column) -> Column:
    """SHA-256 of the lower-case letters and digits; NULL where there are none."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(kept) > 0, F.sha2(kept, 256))


def row_id(reference: Column) -> Column:
    """First 16 hex digits of the reference's SHA-256."""
    return F.substring(F.sha2(reference.cast("string"), 256), 1, 16)


def drop_unreadable(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(fingerprint(F.col(text)).isNotNull())


def unreadable_counts(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n_rows"), F.count_if(fingerprint(F.col(text)).isNull()).alias("n_dropped"))


def deduplicate(df: DataFrame, order: list[Column], text: str = "text") -> DataFrame:
    """One row for each fingerprint, the least in ``order``: an aggregation, so a group of copies never meets in one task."""
    df = df.withColumn("fp", fingerprint(F.col(text))).where("fp is not null")
    best = df.groupBy("fp").agg(F.min_by(F.struct(*[c for c in df.columns if c != "fp"]), F.struct(*order)).alias("r"))
    return best.select("r.*", "fp")


def removed_pairs(df: DataFrame, order: list[Column], text: str = "text", source: str = "source") -> DataFrame:
    """Counts of removed rows by their source and the source of the row kept: of each group of copies, all rows but one."""
    rows = df.select(F.col(source).alias("_source"), F.struct(*order).alias("_order"), fingerprint(F.col(text)).alias("fp")).where("fp is not null")
    counts = rows.groupBy("fp", "_source").agg(F.count("*").alias("n"), F.min("_order").alias("_order"))
    groups = counts.groupBy("fp").agg(F.sum("n").alias("_all"), F.min_by("_source", "_order").alias("kept_source")).where("_all > 1")
    removed = counts.join(groups, "fp").withColumn("n", F.col("n") - F.col("_source").eqNullSafe(F.col("kept_source")).cast("int")).where("n > 0")
    return removed.groupBy(F.col("_source").alias("removed_source"), "kept_source").agg(F.sum("n").alias("n"))


def category_conflicts(df: DataFrame, text: str = "text", category: str = "category") -> DataFrame:
    """Combinations of categories inside groups of copies."""
    groups = df.withColumn("fp", fingerprint(F.col(text))).where("fp is not null").groupBy("fp").agg(F.array_sort(F.collect_set(category)).alias("c"))
    return groups.where(F.size("c") > 1).groupBy(F.array_join("c", "/").alias("categories")).agg(F.count("*").alias("n_groups"))


def with_attack_flag(df: DataFrame, attack: tuple[str, ...] = ("phishing", "fraud"), category: str = "category") -> DataFrame:
    return df.withColumn("is_attack", F.col(category).isin(*attack))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that aren't unique; must be empty."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts with margins (NULL replaced by ``all``)."""
    c = df.cube(rows, columns).agg(F.count("*").alias("n"), F.grouping(rows).alias("gr"), F.grouping(columns).alias("gc"))
    return c.select(F.when(F.col("gr") == 1, "all").otherwise(F.col(rows)).alias(rows), F.when(F.col("gc") == 1, "all").otherwise(F.col(columns)).alias(columns), "n")


def drop_message_copies(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each complete key; rows with a NULL in the key all stay."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    kept = df.where(whole).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")
    return kept.unionByName(df.where(~whole))
