"""Cutting of lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; where it is unset, a temporary folder on a local master only, as other machines can't read it."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with its own or an equivalent schema: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, in sorted buckets of ``key``: tables of equal buckets join on it without a shuffle."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/{name}"
    df.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the catalog's entry only: a table with a path of its own keeps its files
    return table


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table dealt to all cores where fewer of its splits hold rows than there are cores: for heavy projections over small files. The table must come without a shuffle.

    A file is cut by its size, but a row group goes to one split whole, so others may be empty; no column is read to tell.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < cores or df.select(F.spark_partition_id().alias("split")).distinct().count() < cores
    return df.repartition(cores) if few else df


#: Bytes of a method that the JVM compiles at most; a larger one is interpreted for good, however often it runs.
COMPILED = 8000


def compiled(df: DataFrame) -> DataFrame:
    """``df`` for large expressions: Spark splits the code of a stage whose method the JVM wouldn't compile. Lowers ``spark.sql.codegen.hugeMethodLimit`` of the session, unless it is lower already."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.codegen.hugeMethodLimit")) > COMPILED:
        conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)
    return df


#: Rows at most, or so, that a task groups or sorts.
PART = 1_000_000


def parts(df: DataFrame, rows: int = PART) -> int:
    """Number of parts that leaves each task so many rows of ``df`` whatever its size, one for each core at least: for ``repartition`` by a key of few rows a value. Counts ``df``."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
