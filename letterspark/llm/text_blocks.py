"""Blocks of whole texts, fingerprints of their n-grams, and the exchange that sums what blocks count.

A block holds the lower-case bytes (A-Z only) of consecutive documents of a partition, up
to ``BLOCK_BYTES`` or one longer document, and is written once, so that its number is a
stable pointer: slot ``k`` of block ``b`` is the ``k``-th of the block's distinct
fingerprints. Numpy reads a block as arrays: prefix polynomials over its bytes give the
fingerprint of every word, prefix polynomials over those the fingerprint of every n-gram.

``exchange`` is one shuffle of packed arrays: each block sends its distinct fingerprints
with their counts, dealt by ranges of the fingerprint; a range sums equal fingerprints and
answers every (block, slot). A frequent n-gram is one entry a block, so no range grows with
a hot n-gram; there are ``RANGES`` ranges for each shuffle partition of the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from letterspark.llm.common import bound_batches

BLOCK_BYTES = 2 << 20
RANGES = 4
#: Odd bases (fixed values) of the polynomials over bytes and over words, modulo 2^64.
BYTE_BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that lets every bit act on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * BYTE_BASE)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** k`` modulo 2^64 for k below ``n`` at least."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(x)
    return have


def prefix_polynomial(symbols: np.ndarray, base: np.uint64) -> np.ndarray:
    """Sums of ``symbols[k] * base ** k`` before every place, modulo 2^64."""
    return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(symbols * powers(base, len(symbols))[: len(symbols)])])


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Equal spans of symbols have equal hashes wherever they stand: the difference of prefixes, moved to the first place."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    back = powers(inverse, int(starts.max(initial=0)) + 1)
    return (prefix[ends] - prefix[starts]) * back[starts]


class Words:
    """The words of a block: bytes ``text`` in which single spaces part them, word ``i`` at ``text[at[i]:at[i + 1] - 1]``, its document, piece and hash."""

    def __init__(self, data: bytes, ends: np.ndarray, kinds: np.ndarray):
        """``ends``: where each document ends in ``data``, one byte apart; ``kinds``: 0 for bytes of words, 1 between words, 2 between pieces."""
        x = np.frombuffer(data, np.uint8)
        kind = kinds[x]
        kind[ends[:-1]] = 2
        word = kind == 0
        before = np.r_[False, word[:-1]]
        starts = np.flatnonzero(word & ~before)
        self.doc = np.searchsorted(ends, starts, "right")
        self.piece = np.add.accumulate(kind == 2, dtype=np.int32)[starts]
        keep = word | before
        if len(x) and word[-1]:
            keep = np.r_[keep, True]
            x, word = np.r_[x, np.uint8(32)], np.r_[word, False]
        self.text = np.where(word, x, np.uint8(32))[keep]
        self.at = np.r_[0, np.flatnonzero(self.text == 32) + 1] if len(starts) else np.zeros(1, np.int64)
        self.hash = mix(span_hashes(prefix_polynomial(_SYMBOLS[self.text], BYTE_BASE), self.at[:-1], self.at[1:] - 1, BYTE_BASE))

    def __len__(self) -> int:
        return len(self.hash)


def gram_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of the n-gram at each place of ``symbols`` that has ``n`` from there on."""
    starts = np.arange(max(0, len(symbols) - n + 1))
    return mix(span_hashes(prefix_polynomial(symbols, WORD_BASE), starts, starts + n, WORD_BASE) + np.uint64(n))


def take_spans(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    first = np.add.accumulate(sizes) - sizes
    return text[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))]


def text_blocks(df: DataFrame, text_col: str, keys: list[str], first: int = 0) -> DataFrame:
    """Rows ``(block, data, ends, *keys)``: lower-case bytes of the texts (null: empty) with one byte between them, 64-bit ends, and each key column as an array.

    ``first`` is added to the numbers, so that blocks of several tables can stand together.
    """
    bound_batches(df)
    fields = [df.schema[k] for k in keys]
    schema = StructType([StructField("block", LongType()), StructField("data", BinaryType()), StructField("ends", BinaryType()), *(StructField(f.name, ArrayType(f.dataType)) for f in fields)])
    limit = BLOCK_BYTES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, texts, held = first + (TaskContext.get().partitionId() << 32), 0, [], []

        def block() -> pa.RecordBatch:
            ends = np.add.accumulate([len(t) + 1 for t in texts]) - 1
            whole = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), whole.column(k).combine_chunks()) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([b"\n".join(texts)], pa.binary()), pa.array([ends.tobytes()], pa.binary()), *lists], ["block", "data", "ends", *keys])

        for batch in batches:
            columns, start = batch.select(keys), 0
            for k, text in enumerate(batch.column("_text")):
                t = (text.as_py() or "").encode().lower()
                if texts and size + len(t) > limit:
                    held.append(columns.slice(start, k - start))
                    yield block()
                    number, size, texts, held, start = number + 1, 0, [], [], k
                texts.append(t)
                size += len(t) + 1
            held.append(columns.slice(start))
        if texts:
            yield block()

    return df.select(F.col(text_col).alias("_text"), *keys).mapInArrow(build, schema)


def pack_counts(x: np.ndarray) -> bytes:
    """Rows of counts: their length, a byte for each count, and those of 255 or more once again in full."""
    return np.uint32(x.shape[1]).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.int64).tobytes()


def unpack_counts(data: bytes, rows: int) -> np.ndarray:
    m = int(np.frombuffer(data, np.uint32, 1)[0])
    x = np.frombuffer(data, np.uint8, rows * m, 4).reshape(rows, m).astype(np.int64)
    x[x == 255] = np.frombuffer(data[4 + rows * m :], np.int64)
    return x


Slots = Callable[[dict], tuple[np.ndarray, np.ndarray]]


def exchange(blocks: DataFrame, slots: Slots, answer: Callable[[np.ndarray], np.ndarray], summary: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows ``(block, part, answer)``: for each block what ``answer`` makes of the sums of its slots' counts, in parts in order.

    ``slots`` gives a block's distinct fingerprints, ascending, and their counts (one row or several); ``answer`` takes sums
    of all blocks as 64-bit columns; 64-bit answers are packed. ``summary`` of the distinct sums of a range comes as a row of block -1.
    """
    spark = blocks.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                prints, counts = slots(row)
                counts = np.atleast_2d(counts)
                cuts = np.searchsorted((prints >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
                some = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
                for a in range(0, len(some), 256):
                    part = some[a : a + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part, pa.int32()),
                            pa.array([row["block"]] * len(part), pa.int64()),
                            pa.array([prints[cuts[k] : cuts[k + 1]].tobytes() for k in part], pa.binary()),
                            pa.array([pack_counts(counts[:, cuts[k] : cuts[k + 1]]) for k in part], pa.binary()),
                            pa.array([len(counts)] * len(part), pa.int32()),
                        ],
                        ["part", "block", "prints", "counts", "rows"],
                    )

    def sums(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("prints")]
        prints = np.concatenate(each)
        counts = np.concatenate([unpack_counts(b.as_py(), n) for b, n in zip(table.column("counts"), table.column("rows").to_pylist())], axis=1)
        order = np.argsort(prints, kind="stable")
        new = np.r_[True, prints[order[1:]] != prints[order[:-1]]]
        total = np.add.reduceat(counts[:, order], np.flatnonzero(new), axis=1)
        group = np.empty(len(prints), np.int64)
        group[order] = np.add.accumulate(new) - 1
        replies, cuts = answer(total), np.r_[0, np.add.accumulate([len(e) for e in each])]
        pack = pack_counts if replies.dtype == np.int64 else lambda x: x.tobytes()
        out = [pack(replies[..., group[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
        numbers, parts = table.column("block").to_pylist(), table.column("part").to_pylist()
        if summary:
            numbers, parts, out = [*numbers, -1], [*parts, parts[0]], [*out, summary(total).tobytes()]
        return pa.table([pa.array(numbers, pa.int64()), pa.array(parts, pa.int32()), pa.array(out, pa.binary())], ["block", "part", "answer"])

    asked = blocks.mapInArrow(ask, "part int, block long, prints binary, counts binary, rows int")
    return asked.groupBy("part").applyInArrow(sums, "block long, part int, answer binary")


def with_answers(blocks: DataFrame, **answers: DataFrame) -> DataFrame:
    """``blocks`` with an array of the parts of each ``exchange`` as a column, null for a block without slots."""
    for name, rows in answers.items():
        parts = F.transform(F.sort_array(F.collect_list(F.struct("part", "answer"))), lambda p: p["answer"])
        blocks = blocks.join(rows.where("block >= 0").groupBy("block").agg(parts.alias(name)), "block", "left")
    return blocks


def flags_of(parts: list[bytes] | None) -> np.ndarray:
    """The true and false answers to a block's slots, in their order."""
    return np.frombuffer(b"".join(parts or []), np.bool_)


def counts_of(parts: list[bytes] | None, rows: int) -> np.ndarray:
    """The packed answers to a block's slots, in their order."""
    return np.concatenate([unpack_counts(p, rows) for p in parts or []] or [np.empty((rows, 0), np.int64)], axis=1)
