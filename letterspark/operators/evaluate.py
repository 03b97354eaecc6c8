"""Evaluation at table scale: counts, F1, thresholds, AUC, matched cuts, cluster bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterspark.plans.prefix import join_on, ranged, running_sum


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Counts, precision, recall and F1 (0 on an empty denominator)."""
    n = df.groupBy(*by).agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumns({"precision": F.round(ratio(tp, tp + fp), 6), "recall": F.round(ratio(tp, tp + fn), 6), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6)})


def macro_f1(confusions: DataFrame, by: list[str]) -> DataFrame:
    return confusions.groupBy(*by).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def tune_threshold(df: DataFrame, by: str, score: Column, truth: Column) -> DataFrame:
    """Best F1 of 19 thresholds; ties: nearest to a half, then the lower. Scores are counted once by threshold step."""
    step = F.least(F.lit(19), F.greatest(F.lit(0), F.floor(F.round(score * 20, 6)))).cast("int")
    n = df.groupBy(by, step.alias("step")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("q"))
    grid = n.sparkSession.range(1, 20).select(F.col("id").cast("int").alias("k"))
    sums = n.crossJoin(F.broadcast(grid)).groupBy(by, "k").agg(  # steps and thresholds: at most 380 rows a label
        F.sum(F.when(F.col("step") >= F.col("k"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("step") >= F.col("k"), F.col("q")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("step") < F.col("k"), F.col("p")).otherwise(0)).alias("fn"),
    )
    f1 = F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("f1"), F.abs(F.col("k") - 10), "k"))
    return sums.withColumn("f1", f1).withColumn("rank", rank).where("rank = 1").select(by, F.round(F.col("k") / 20, 2).alias("threshold"), "f1")


def weighted_auc(df: DataFrame, by: str, score: str, truth: Column, weight: Column | None = None) -> DataFrame:
    """AUC with ties as half, from one row for each score and sums over score ranges."""
    w = weight if weight is not None else F.lit(1)
    n = df.groupBy(by, score).agg(F.sum(F.when(truth, w).otherwise(0)).alias("p"), F.sum(F.when(truth, 0).otherwise(w)).alias("q"))
    n, place = ranged(n, score)
    n = running_sum(n, [by], score, "q", "below", score, bucket=place)
    s = n.groupBy(by).agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("s"), F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    return s.select(by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.round(F.col("s") / (F.col("pos") * F.col("neg")), 6)).alias("auc"))


def matched_cut(df: DataFrame, score: str, truth: Column, rate: float) -> DataFrame:
    """The (k+1)-th largest score of the negatives, k = floor(rate * negatives)."""
    negative = df.where(~truth)
    counts = negative.groupBy(score).agg(F.count("*").alias("n")).withColumn("_all", F.lit(0)).withColumn("_neg", -F.col(score))
    counts, place = ranged(counts, "_neg")
    ranked = running_sum(counts, ["_all"], "_neg", "n", "above", score, bucket=place)
    total = negative.agg(F.floor(F.count("*") * rate).alias("k"))
    return ranked.crossJoin(F.broadcast(total)).where("above <= k and k < above + n").agg(F.max(score).alias("cut"))


#: Resamples of every interval.
DRAWS = 1000


def bootstraps(df: DataFrame, cluster: str, sums: dict[str, Column], statistics: dict[str, Column], draws: int = DRAWS, seed: int = 1) -> DataFrame:
    """``(statistic, value, low, high)``: percentile intervals over resampled clusters; slot j of draw b takes cluster hash(seed, b, j) mod n.

    All statistics share the draws, so one made of the sums of two systems is a paired difference.
    Cluster sums come first; draws are aggregated to weights before they meet the sums.
    """
    spark = df.sparkSession
    per = df.groupBy(cluster).agg(*(v.alias(k) for k, v in sums.items()))
    n = per.count()
    per = running_sum(per.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0)).withColumn("_pos", F.pmod(F.xxhash64(cluster), F.lit(1 << 20)) / float(1 << 20)), ["_all"], "_pos", "_one", "_no", cluster)
    slots = spark.range(draws * n).select((F.col("id") / n).cast("int").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("_no"))
    weights = slots.groupBy("draw", "_no").agg(F.count("*").alias("_w"))
    drawn = weights.join(per, "_no").groupBy("draw").agg(*(F.sum(F.col(k) * F.col("_w")).alias(k) for k in sums))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("statistic"), v.cast("double").alias("v")) for k, v in statistics.items()))).alias("x")
    point = per.agg(*(F.sum(k).alias(k) for k in sums)).select(each).select("x.statistic", F.col("x.v").alias("value"))
    ends = drawn.select(each).groupBy("x.statistic").agg(F.percentile("x.v", F.lit(0.025)).alias("low"), F.percentile("x.v", F.lit(0.975)).alias("high"))
    return point.join(ends, "statistic")


def bootstrap(df: DataFrame, cluster: str, sums: dict[str, Column], statistic: Column, draws: int = DRAWS, seed: int = 1) -> DataFrame:
    """The interval of one statistic (``bootstraps``)."""
    return bootstraps(df, cluster, sums, {"": statistic}, draws, seed).select("value", "low", "high")


def draw_weights(hashes: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Times that each cluster (its 64-bit hash) counts in each draw: Poisson with mean 1, from a hash of both, so alike wherever the cluster is read."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64)[:, None] ^ ((np.arange(1, draws + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) * 2.0**-53, "right").astype(np.uint8)


#: Distribution function of a Poisson number with mean 1.
_POISSON = np.add.accumulate([math.exp(-1) / math.factorial(k) for k in range(20)])


def intervals(df: DataFrame, by: list[str], cluster: str, sums: dict[str, Column], statistics: dict[str, Column], draws: int = DRAWS, seed: int = 1) -> DataFrame:
    """``(*by, statistic, value, low, high)``: percentile intervals over clusters that count a random number of times in each draw.

    A cluster's sums come together in one task, so its draws are made once for all groups; they are added up inside the
    task, so what is shuffled then is one row for each task, group and draw, whatever the number of clusters. All statistics and groups share the draws: one of the sums of several
    systems or views is a paired difference, also of differences.
    """
    names = list(sums)
    per = df.groupBy(*by, cluster).agg(*(v.cast("double").alias(k) for k, v in sums.items())).select(*by, F.xxhash64(cluster).alias("_h"), *names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in per.schema if f.name in by)
    schema = f"{kinds + ', ' if by else ''}_draw int, {', '.join(f'`{k}` double' for k in names)}"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                hashes, at_ = np.unique(part.column("_h").to_numpy(), return_inverse=True)
                weights = draw_weights(hashes, draws, seed)
                values = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in names], 1)
                keys = list(zip(*(part.column(k).to_pylist() for k in by))) if by else [()] * part.num_rows
                places: dict[tuple, list[int]] = {}
                for k, key in enumerate(keys):
                    places.setdefault(key, []).append(k)
                for key, rows in places.items():
                    total[key] = total.get(key, 0) + weights[at_[rows]].T.astype(float) @ np.nan_to_num(values[rows])
        for key, sums_ in total.items():
            columns = [pa.array([v] * draws, part.schema.field(k).type) for k, v in zip(by, key)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(draws, dtype=np.int32)), *(pa.array(sums_[:, k]) for k in range(len(names)))], [*by, "_draw", *names])

    drawn = per.repartition("_h").sortWithinPartitions("_h").mapInArrow(add, schema).groupBy(*by, "_draw").agg(*(F.sum(k).alias(k) for k in names))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("statistic"), v.cast("double").alias("v")) for k, v in statistics.items()))).alias("x")
    point = per.groupBy(*by).agg(*(F.sum(k).alias(k) for k in names)).select(*by, each).select(*by, "x.statistic", F.col("x.v").alias("value"))
    ends = drawn.select(*by, each).groupBy(*by, "x.statistic").agg(F.percentile("x.v", F.lit(0.025)).alias("low"), F.percentile("x.v", F.lit(0.975)).alias("high"))
    return join_on(point, ends, [*by, "statistic"], "left")


def view_contrasts(df: DataFrame, cluster: str, view: str, truth: Column, systems: dict[str, Column], base: str, others: list[str], draws: int = DRAWS) -> DataFrame:
    """``(statistic, value, low, high)`` over rows of several views: F1 of each system in each view, the drop from the base view, and the drop of each drop between systems."""
    sums, f1 = {}, {}
    for v in [base, *others]:
        for name, hit in systems.items():
            here = F.col(view) == v
            k = f"{name}@{v}"
            sums |= {f"{k}:tp": F.count_if(here & truth & hit), f"{k}:fp": F.count_if(here & ~truth & hit), f"{k}:fn": F.count_if(here & truth & ~hit)}
            tp, fp, fn = (F.col(f"`{k}:{x}`") for x in ("tp", "fp", "fn"))
            f1[k] = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    drop = {f"drop {n}@{v}": f1[f"{n}@{base}"] - f1[f"{n}@{v}"] for v in others for n in systems}
    pairs = [(a, b) for k, a in enumerate(systems) for b in list(systems)[k + 1 :]]
    twice = {f"drop {a} - drop {b}@{v}": drop[f"drop {a}@{v}"] - drop[f"drop {b}@{v}"] for v in others for a, b in pairs}
    return intervals(df, [], cluster, sums, f1 | drop | twice, draws)


def cooccurrence(df: DataFrame, item: str, label: str) -> DataFrame:
    """Pairs of labels on the same item with their Jaccard index."""
    rows = df.select(item, label).distinct()
    size = rows.groupBy(label).agg(F.count("*").alias("size"))
    pairs = rows.alias("x").join(rows.alias("y"), item).where(F.col(f"x.{label}") < F.col(f"y.{label}"))
    n = pairs.groupBy(F.col(f"x.{label}").alias("a"), F.col(f"y.{label}").alias("b")).agg(F.count("*").alias("both"))
    n = n.join(F.broadcast(size.select(F.col(label).alias("a"), F.col("size").alias("na"))), "a").join(F.broadcast(size.select(F.col(label).alias("b"), F.col("size").alias("nb"))), "b")
    return n.select("a", "b", "both", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("jaccard"))


def detector_agreement(df: DataFrame, by: list[str], one: Column, two: Column) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(one & two).alias("both"), F.count_if(one & ~two).alias("only_a"), F.count_if(~one & two).alias("only_b"), F.count_if(~one & ~two).alias("neither")
    )


def kappa(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two annotators (NULL where chance agreement is 1), agreement and positives."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.sum(a).alias("pos_a"), F.sum(b).alias("pos_b"), F.count_if(F.col(a) == F.col(b)).alias("same"), F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("both")
    )
    po = F.col("same") / F.col("n")
    pe = (F.col("pos_a") * F.col("pos_b") + (F.col("n") - F.col("pos_a")) * (F.col("n") - F.col("pos_b"))) / (F.col("n") * F.col("n"))
    k = F.when(pe < 1, F.round((po - pe) / (1 - pe), 6))
    scale = F.when(k.isNull(), None).when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("almost perfect")
    return n.select(by, "n", "pos_a", "pos_b", "both", F.round(po, 6).alias("agreement"), k.alias("kappa"), scale.alias("reading"))


def majority(df: DataFrame) -> DataFrame:
    """Votes a1, a2 and tie of each item and label: agreed, decided by the tie-breaker, or pending (NULL)."""
    value = F.when(F.col("a1") == F.col("a2"), F.col("a1")).otherwise(F.col("tie"))
    source = F.when(F.col("a1") == F.col("a2"), "agreed").when(F.col("tie").isNotNull(), "tie-breaker").otherwise("pending")
    return df.select("doc_id", "label", value.alias("value"), source.alias("label_source"))


def disagreements(df: DataFrame, asked: DataFrame) -> DataFrame:
    """Items on which the annotators differ and that haven't been asked yet."""
    return df.where("a1 <> a2").join(asked, ["doc_id", "label"], "left_anti").select("doc_id", "label")


def check_row(df: DataFrame, check: str, value: Column, expected: int) -> DataFrame:
    """A row (check, value, expected, status)."""
    return df.agg(value.cast("long").alias("value")).select(F.lit(check).alias("check"), "value", F.lit(expected).cast("long").alias("expected"), F.when(F.col("value") == expected, "PASS").otherwise("FAIL").alias("status"))
