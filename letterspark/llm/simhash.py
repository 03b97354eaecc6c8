"""SimHash fingerprints and near-duplicate classes by tiled exact comparison.

Fingerprints: texts with A-Z in lower case are cut into words at ASCII white space; each
shingle of three words (fewer words: the whole sequence) is hashed with XXH64, seed 42,
and a bit of the fingerprint is set if it is set in over half the hashes.

Comparison: equal fingerprints are one class from the start. Two fingerprints that differ
in at most two bits agree on at least two of four 16-bit bands, so each pair of bands is a
block key and no link is lost. The fingerprints of a block are ordered by population count
and compared tile by tile with numpy exclusive-or and bit counts; tile pairs whose
population counts differ by more than the radius are skipped. A large block is dealt out as
many tile pairs, so no task holds a whole block. A tile pair yields the links of a spanning
forest only, which keeps every component and avoids all pairs of a group.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any
other. Repeated rows get equal results. An empty table gives an empty table. Rows with a
null id take part in linking and get the class's least non-null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterspark.llm.common import bound_batches, fresh, publish
from letterspark.plans.components import connected_components
from letterspark.plans.shared import cut

SEED, RADIUS = 42, 2
#: Fingerprints in a tile.
TILE = 512
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 14
BANDS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def shingle_hashes(text: str | None, words: int = 3) -> list[int]:
    w = (text or "").encode().lower().split()
    if not w:
        return []
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return [digest(b" ".join(w), SEED)]
    return [digest(s, SEED) for s in map(b" ".join, zip(*(w[i:] for i in range(words))))]


def fingerprint(hashes: list[int]) -> int:
    if not hashes:
        return 0
    h = np.array(hashes, "<u8")
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[a : a + BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def with_fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit integer."""
    bound_batches(df)

    @F.arrow_udf("long")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(shingle_hashes(t.as_py())) for t in texts], pa.int64())

    return df.withColumn(out_col, fingerprints(F.col(text_col)))


def links_in(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of two tiles within the radius."""
    pl, pr = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    if pl.min() - pr.max() > radius or pr.min() - pl.max() > radius:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position linked to each of ``n`` positions."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile pair. Yields links (a > b) of each tile pair's spanning forest."""
    rest: tuple[np.ndarray, ...] = ()
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])

    def links(key: np.ndarray, fp: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out_a, out_b = [], []
        for s, e in zip(starts, np.r_[starts[1:], len(key)]):
            if e - s < 2:
                continue
            fps, sides = fp[s:e].view(np.uint64), side[s:e]
            l, r = np.flatnonzero(sides <= 1), np.flatnonzero(sides != 1)  # side 0: compared within the tile
            x, y = links_in(fps[l], fps[r]) if len(l) and len(r) else (l[:0], r[:0])
            if len(x):
                x, y = l[x], r[y]
                order = np.argsort(fp[s:e], kind="stable")  # the least position is the least fingerprint
                place = np.empty(e - s, np.int64)
                place[order] = np.arange(e - s)
                root = forest(e - s, place[x], place[y])
                ordered = fp[s:e][order]
                linked = ordered[root] != ordered
                out_a.append(ordered[linked])
                out_b.append(ordered[root[linked]])
        if not out_a:
            return empty
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    for batch in batches:
        now = tuple(batch.column(c).to_numpy() for c in ("pair", "fp", "side"))
        now = tuple(np.concatenate(x) for x in zip(rest, now)) if rest else now
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        rest = tuple(x[last:] for x in now)
        if last:
            yield links(*(x[:last] for x in now))
    if rest:
        yield links(*rest)


def fingerprint_links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints (column ``fp``, distinct) within the radius into their components."""

    def band(i: int):
        return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)

    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.shiftleft(band(i), 16).bitwiseOR(band(j)).alias("bits")) for k, (i, j) in enumerate(BANDS)))
    rows = distinct.select("fp", F.explode(keys).alias("key")).select("fp", (F.shiftleft("key.k", 32).bitwiseOR(F.col("key.bits"))).alias("key"))
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    rows = rows.join(shared, "key")
    small = rows.where(F.col("n") <= tile).select(F.xxhash64("key").alias("pair"), "fp", F.lit(0).cast("byte").alias("side"))

    # A large block: tiles by population count and a slot; a tile meets those up to RADIUS counts away.
    p, slots = F.bit_count("fp").cast("int"), F.ceil(F.col("n") / (4 * tile)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("slots")).cast("int")
    large = (
        rows.where(F.col("n") > tile)
        .withColumns({"p": p, "slots": slots})
        .withColumn("s", own)
        .withColumn("d", F.explode(F.sequence(F.lit(-RADIUS), F.lit(RADIUS))))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        .withColumn("q", F.col("p") + F.col("d"))
    )
    here, there = F.struct(F.col("p"), F.col("s")), F.struct(F.col("q").alias("p"), F.col("t").alias("s"))
    side = F.when(here == there, 0).when(here < there, 1).otherwise(2).cast("byte")
    low, high = F.least(here, there), F.greatest(here, there)
    large = large.select(F.xxhash64("key", low, high, F.lit(1)).alias("pair"), "fp", side.alias("side"))

    dealt = small.unionByName(large).repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def near_duplicate_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, fp, class, component_id)`` and the columns ``carry`` for every row: the class's least fingerprint, and the least id reachable by links."""
    prints = publish(with_fingerprints(documents.select(id_col, text_col, *carry), text_col, "fp").select(id_col, "fp", *carry))
    groups = publish(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    found = connected_components(fingerprint_links(groups.select("fp")))
    linked = groups.join(found, groups.fp == found.node).select("fp", "least_id", "component")
    least = publish(linked.groupBy("component").agg(F.min("least_id").alias("component_id")))
    linked = linked.join(least, "component").select("fp", F.col("component").alias("class"), "component_id")
    classes = groups.join(linked, "fp", "left").select("fp", F.coalesce("class", "fp").alias("class"), F.coalesce("component_id", "least_id").alias("component_id"))
    return prints.join(publish(classes), "fp")


def simhash_classes(documents: DataFrame) -> DataFrame:
    """Fingerprints and classes of all documents (the contract of ``op9``)."""
    return near_duplicate_classes(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def with_row_key(documents: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds three columns of fresh names: the id and 128 bits of all columns, never null; wholly equal rows share them."""
    names = [fresh(documents, f"r{k}") for k in range(3)]
    nulls = [F.col(c).isNull() for c in documents.columns]
    hashes = [F.xxhash64(F.lit(k), *nulls, *documents.columns) for k in (1, 2)]
    return documents.withColumns(dict(zip(names, (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), *hashes)))), names


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each class: the least by id (nulls last), then by hashes of all columns; of wholly equal rows one stays. Other columns are kept under any name."""
    rows, names = with_row_key(documents)
    keys = publish(near_duplicate_classes(rows, carry=tuple(names)).select("class", "doc_id", *names))
    order = F.struct(F.col("doc_id").isNull().alias("last"), *names)
    best = publish(keys.groupBy("class").agg(F.min(order).alias("best")))
    judged = keys.join(best, "class").select(*names, (order == F.col("best")).alias("stays"))
    gone = publish(judged.groupBy(*names).agg(F.first("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    # rows that go are as many as the corpus makes them: never broadcast, so the work is of one kind at any size
    out = rows.join(gone.select(*names).hint("merge"), names, "left_anti")
    repeated = gone.where("stays")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated.select(*names), names, "left_semi").dropDuplicates(names))
    return out.drop(*names)
