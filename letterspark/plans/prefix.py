"""Running sums over large groups without a window over a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterspark.plans.shared import cut

BUCKETS = 1024


def ranged(df: DataFrame, *order: str) -> tuple[DataFrame, Column]:
    """``df`` in contiguous ranges of ``order``, as many as the session's shuffle partitions, and the number of a row's range.

    The ranges are checkpointed, as sampling may cut them elsewhere when they are computed again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())), F.col("_range")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of equal names in which nulls equal each other; the left side's keys stay."""
    names = {k: f"_on{i}" for i, k in enumerate(keys)}
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def running_sum(df: DataFrame, by: list[str], position: str, value: str, out: str, tie: str, bucket: Column | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in ``by``, ordered by ``position`` and ``tie``.

    ``position`` lies in [0, 1) and is even (a hash); it is cut into equal ranges, eight for each shuffle partition
    and ``BUCKETS`` at least. For other positions ``bucket`` must rise with them (``ranged``). The sums of the ranges
    are few rows for each group, and the remaining windows hold one range of a group each, so no task sees a whole
    group. A null group, position or value is kept: nulls form a group of their own, come first and count 0.
    """
    n = max(BUCKETS, 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("_bucket", bucket if bucket is not None else F.floor(F.col(position) * n).cast("int"))
    keys = [*by, "_bucket"]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys).orderBy(position, tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = join_on(df, offsets, keys)
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_bucket", "_base")
