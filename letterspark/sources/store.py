"""A versioned table of features that is published whole: data first, then one small manifest that names it.

Every write puts its rows in a folder of their own and then adds a manifest, a single file that appears by one rename.
Readers take the last manifest and see its folders only, so a write that dies leaves the table as it was, and readers
never see half of one. Rows are kept under a version; an update computes the keys that the version lacks and appends them.
One writer at a time is assumed; old folders stay for readers that still use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterspark.sources.messages import missing_keys

_MANIFEST = "number long, version string, folders array<string>"


def last_manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, list[str]]]:
    """Number of the last manifest and the folders of each version; 0 and none for a new store."""
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{path}/manifests/*")
        last = rows.agg({"number": "max"}).first()[0]
    except AnalysisException:  # no such path yet
        return 0, {}
    return (last or 0), {r.version: list(r.folders) for r in rows.where(rows.number == (last or 0)).collect()}  # one row a version


def commit(df: DataFrame, path: str, version: str, replace: bool = False) -> None:
    """Adds the rows to a version of the store, or takes their place."""
    spark = df.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    number, versions = last_manifest(spark, path)
    versions[version] = ([] if replace else versions.get(version, [])) + [folder]
    rows = spark.createDataFrame([(number + 1, v, f) for v, f in versions.items()], _MANIFEST)
    rows.coalesce(1).write.json(f"{path}/manifests/{number + 1:012d}")


def read(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """The rows of a version as of the last manifest; None if it has none."""
    folders = last_manifest(spark, path)[1].get(version)
    return spark.read.parquet(*(f"{path}/{f}" for f in folders)) if folders else None


def update(rows: DataFrame, path: str, key: str, version: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The whole version after ``compute`` has run on the rows whose keys it lacked, and on no others."""
    store = read(rows.sparkSession, path, version)
    todo = rows if store is None else missing_keys(rows, store.withColumn("version", F.lit(version)), key, version)
    if not todo.isEmpty():
        commit(compute(todo), path, version)
    return read(rows.sparkSession, path, version)
