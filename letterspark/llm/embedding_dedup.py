"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells.

Vectors are compared if their labels are equal and not null; a link is a cosine of 0.93 or
more in double precision. Equal vectors of a label are one class with a weight. Centroids
are fitted by spherical k-means on a bounded sample (``SAMPLE`` classes, or four for each cell, the
first in the order of a hash), every class is assigned to the nearest centroid's cell, and cells are
compared in blocks.

No link across cells is lost: if y, of cell j, is linked to a vector of cell i, then
(c_j - c_i) . y is at most the greatest distance of linked unit vectors times |c_j - c_i|;
wherever that holds and i < j, y also visits cell i. So each pair meets once at most, and
every linked pair once. A cell with many vectors is dealt out as pairs of tiles. A tile
pair yields the summed weights of each class's links and the links of a spanning forest,
never all pairs.

Defined results: a vector that is null, empty or zero, that holds a null or non-finite
component, or whose label is null links with nothing. Vectors of different lengths link
with nothing of another length. Ids are taken as unique up to wholly repeated rows; rows
with a null id are left out of linking. An empty table gives an empty table. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterspark.llm.common import bound_batches, publish
from letterspark.llm.simhash import forest
from letterspark.plans.components import connected_components

COSINE = 0.93
#: Classes that the centroids are fitted on, and rounds.
SAMPLE, ROUNDS = 4096, 10
#: Classes of the largest label for each cell. Cells at most: bounds the broadcast centroids and the table of distances
#: between them (32 MB); beyond, cells hold more classes and are dealt out in more tiles, which finds the same links.
CELL, MAX_CELLS = 4096, 2048
#: Classes in a tile, and rows of a product at a time.
TILE, ROWS = 2048, 512


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors; starts from points far from each other, so it is deterministic."""
    at, near = [0], x @ x[0]
    while len(at) < min(k, len(x)):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        cell = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is the row's own cell, for each cell that a unit vector belongs to or visits."""
    near = x @ c.T
    own = near.argmax(1)
    reach = np.sqrt(2 - 2 * cosine) + 1e-9
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) + 1e-7
    visits = near[np.arange(len(x)), own][:, None] - near <= reach * apart[own] + 1e-9
    visits &= np.arange(len(c)) < own[:, None]
    visits[np.arange(len(x)), own] = True
    row, cell = np.nonzero(visits)
    return row, cell, cell == own[row]


def linked(batches: Iterator[pa.RecordBatch], cosine: float = COSINE) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group. Yields ``(id, links, root)``: weight of an id's links in a group, and the least id linked there."""

    def solve(ids, vectors, weights, home, side) -> tuple[list, list, list]:
        x = vectors.astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        norm = np.linalg.norm(x, axis=1)
        order = np.argsort(ids, kind="stable")
        ids, x, norm, w, home, side = (np.asarray(v)[order] for v in (ids, x, norm, weights, home, side))
        left = np.flatnonzero(side <= 1)
        right = np.flatnonzero(side != 1)  # side 0: compared within the tile
        sums, a, b = np.zeros(len(ids), np.int64), [], []
        for k in range(0, len(left), ROWS):
            rows = left[k : k + ROWS]
            near = (x[rows] @ x[right].T) / np.outer(norm[rows], norm[right])
            hit = (near >= cosine) & (home[rows][:, None] | home[right][None, :])
            hit &= (side[rows][:, None] == 1) | (rows[:, None] < right[None, :])
            i, j = np.nonzero(hit)
            i, j = rows[i], right[j]
            np.add.at(sums, i, w[j])
            np.add.at(sums, j, w[i])
            a.append(i)
            b.append(j)
        root = forest(len(ids), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(ids))
        some = sums > 0
        return ids[some].tolist(), sums[some].tolist(), ids[root[some]].tolist()

    def result(out: list[tuple[list, list, list]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v for o in out for v in o[k]], pa.int64()) for k in range(3)], ["id", "links", "root"])

    group, pieces = None, []

    def solved() -> list[tuple[list, list, list]]:
        """The group gathered so far, if it has two rows or more."""
        if sum(len(p[0]) for p in pieces) < 2:
            return []
        return [solve(*(np.concatenate(x) for x in zip(*pieces)))]

    for batch in batches:
        out = []
        grp, ids, weights, side = (batch.column(c).to_numpy() for c in ("grp", "cid", "w", "side"))
        home, vectors = batch.column("home").to_numpy(zero_copy_only=False), batch.column("embedding")
        starts = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]]) if len(grp) else []
        for s, e in zip(starts, [*starts[1:], len(grp)]):
            if grp[s] != group:
                out += solved()
                group, pieces = grp[s], []
            x = vectors.slice(s, e - s).flatten().to_numpy().reshape(e - s, -1)  # a group's vectors are of one length
            pieces.append((ids[s:e], x, weights[s:e], home[s:e], side[s:e]))
        yield result(out)
    yield result(solved())


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row (the contract of ``op5``)."""
    spark = vectors.sparkSession
    bound_batches(vectors)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    usable = rows.where("vec_id is not null and label is not null and size(embedding) > 0").where(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    classes = publish(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("w")))
    each = classes.groupBy("label", F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    # lengths whose labels fit in one cell need no centroids
    sizes = {r.d: r.n for r in each.groupBy("d").agg(F.max("n").alias("n")).where(F.col("n") > CELL).orderBy("d").collect()}
    centroids = {}
    for d, n in sizes.items():
        k = min(MAX_CELLS, -(-n // CELL))
        sample = classes.where(F.size("embedding") == d).select("embedding", "cid", "label").orderBy(F.xxhash64("cid"), "cid", "label").limit(max(SAMPLE, 4 * k)).select("embedding").toArrow()
        centroids[d] = spherical_kmeans(_unit(sample.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, d).astype(np.float64)), k)
    shared = spark.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<int>")
    def placed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Twice the number of each cell of a vector, and one more for its own."""
        for batch in batches:
            size = batch.value_lengths().to_numpy(zero_copy_only=False)
            row, code = [], []
            for d in np.unique(size):
                these = np.flatnonzero(size == d)
                if int(d) not in shared.value:
                    row.append(these)
                    code.append(np.ones(len(these), np.int32))
                    continue
                for k in range(0, len(these), 2048):
                    some = these[k : k + 2048]
                    x = batch.take(pa.array(some)).flatten().to_numpy().reshape(len(some), d).astype(np.float64)
                    r, cell, home = cells_of(_unit(x), shared.value[int(d)], cosine)
                    row.append(some[r])
                    code.append((2 * cell + home).astype(np.int32))
            row, code = (np.concatenate(row), np.concatenate(code)) if row else (np.empty(0, np.int64), np.empty(0, np.int32))
            order = np.argsort(row, kind="stable")
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(size)))].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(code[order]))

    found = classes.withColumn("p", F.explode(placed("embedding")))
    found = found.select("cid", "embedding", "w", (F.col("p") % 2 == 1).alias("home"), F.struct("label", F.size("embedding").alias("d"), F.floor(F.col("p") / 2).cast("int").alias("cell")).alias("key"))
    found = publish(found)
    count = publish(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    found = found.join(count, "key").withColumn("slots", F.when(F.col("n") <= 2 * tile, 1).otherwise(F.ceil(F.col("n") / tile)).cast("int"))
    found = found.withColumn("s", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("slots")).cast("int"))
    found = found.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    side = F.when(F.col("s") == F.col("t"), 0).when(F.col("s") < F.col("t"), 1).otherwise(2).cast("int")
    dealt = found.select(F.xxhash64("key", F.least("s", "t"), F.greatest("s", "t")).alias("grp"), "cid", "embedding", "w", "home", side.alias("side"))
    links = publish(dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(lambda it: linked(it, cosine), "id long, links long, root long"))

    sums = links.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(links.select("id", "root"), "id", "root")
    known = classes.join(sums, classes.cid == sums.id, "left").drop("id").join(parts, F.col("cid") == parts.node, "left")
    known = publish(known.select("label", "embedding", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id")))
    joined = usable.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), "embedding", "label")
    bad = rest.where(
        "vec_id is null or label is null or embedding is null or size(embedding) <= 0 or exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf')) or not exists(embedding, x -> x <> 0)"
    ).drop("embedding", "label")
    return joined.unionByName(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))
