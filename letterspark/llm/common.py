"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterspark.plans.shared import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``; a temporary one where it is unset on a local master)."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


#: Bytes in an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def bound_batches(df: DataFrame) -> None:
    """Lowers the session's bound on an Arrow batch: whole texts, unlike numbers, make 10,000 rows large on both sides of the pipe."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(conf.get(key).rstrip("b"))
    if now <= 0 or now > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """While a table is written: shuffle files go when the job ends, as the table takes their place."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def publish(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def publish_bucketed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of both as a table like ``publish``'s, bucketed by the join's own partitions: later joins on ``keys`` move the other side only."""
    spark = left.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"bucketed_{uuid.uuid4().hex}"
    joined = left.repartition(n, *keys).join(right.repartition(n, *keys), keys)
    writer = joined.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    with _tidy(spark):
        writer.bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the catalog's entry only: a table with a path of its own keeps its files
    return table


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Null-safe join key of a document row; rows equal in both columns share it."""
    return [F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("_k0"), F.xxhash64(F.col(id_col).isNull(), F.col(text_col)).alias("_k1")]


KEY = ["_k0", "_k1"]


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to clash with no column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to ``limit`` at most, or hold one item."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
