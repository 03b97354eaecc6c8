"""Sources of messages and the tables that stages leave for each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def labelled_csv(spark: SparkSession, path: str, columns: list[str], label: str, categories: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows of all-text CSV files with a known label, as ``category``, and the counts of the labels that were dropped."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True, multiLine=True, escape='"')
    category = F.lit(None).cast("string")
    for name, value in categories.items():
        category = F.when(F.trim(label) == name, value).otherwise(category)
    rows = rows.withColumn("category", category).withColumn("raw_ref", F.input_file_name())
    return rows.where("category is not null"), rows.where("category is null").groupBy(label).agg(F.count("*").alias("n"))


def message_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One message a file; the label is the folder. Hidden files and ``cmds`` lists are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.substring_index("path", "/", -1)
    files = files.where(~name.startswith(".") & (name != "cmds"))
    return files.select(F.col("path").alias("raw_ref"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("label"), F.decode("content", "UTF-8").alias("raw"))


def mailbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mailbox files, split at lines that begin with ``From ``; the reference ends in the message's number.

    The separator is that of the text source, so a large file is read by many tasks, each from the first separator in its
    byte range. Messages are numbered in their range, and ranges by the counts of those before them in the file.
    """
    rows = spark.read.option("lineSep", "\nFrom ").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))).join(counts.withColumn("before", before).drop("n"), ["file", "block"])
    number = F.col("before") + F.col("k")
    text = F.regexp_replace("value", r"\r\n?", "\n")
    begins = (number > 1) | F.startswith("value", F.lit("From "))  # what stands before the first separator is no message
    first = numbered.groupBy("file").agg(F.max((number == 1) & F.startswith("value", F.lit("From "))).alias("whole"))
    out = numbered.where(begins).join(first, "file")
    no = number - F.when(F.col("whole"), 0).otherwise(1)
    return out.select(F.concat_ws("#", "file", no).alias("raw_ref"), F.regexp_replace(text, r"^[^\n]*\n?", "").alias("raw"))


def union_of_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All sources in their order of priority, with name and rank."""
    tagged = [df.withColumns({"source": F.lit(name), "source_rank": F.lit(k)}) for k, (name, df) in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def split_scan(df: DataFrame, split: str, columns: list[str], column: str = "split") -> DataFrame:
    """The rows of one split with the named columns; filter and columns reach the scan."""
    return df.where(F.col(column) == split).select(*columns)


def publish_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replaces a table, or the partitions that ``df`` holds, when the whole job has succeeded."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def result_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def missing_keys(df: DataFrame, store: DataFrame, key: str, version: str) -> DataFrame:
    """Rows that a versioned store doesn't hold under this version: all that an incremental run must compute."""
    return df.join(store.where(F.col("version") == version).select(key).distinct(), key, "left_anti")


def typed_cell(text: Column) -> tuple[Column, Column]:
    """Text with the empty string as NULL, and its number where it is plain (codes with leading zeros stay text)."""
    return F.nullif(text, F.lit("")), F.when(text.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$"), text.try_cast("double"))
