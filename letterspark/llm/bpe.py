"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

``encode`` adds a binary column of token ids (little-endian unsigned 32-bit integers),
``decode`` turns such a column back into bytes. Each match of the split pattern (a
pre-token) is merged on its own: buckets per merge rank hold the positions of a linked
list of symbols, a bitmap of two levels finds the lowest non-empty rank by
find-first-set, and entries whose pair has changed meanwhile are skipped as stale. A
merge costs O(log n), so pre-tokens of millions of bytes are fine.

Defined results: a null text counts as empty; an empty text has no ids (an empty
binary value). Long texts are split piece by piece. Other columns are kept; a column
that has the output's name is replaced. Rows are independent, so repeated rows and
empty tables need no care.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterspark.llm.common import bound_batches, fresh

#: A rank file larger than this isn't broadcast.
MAX_RANK_FILE = 64 << 20
#: Pre-tokens up to this many characters are remembered; so many of them twice (a newer and an older half) at most.
CACHED_CHARS, CACHED = 48, 1 << 18
#: Texts longer than this are split with an iterator.
LONG_TEXT = 1 << 21


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a ``.tiktoken`` file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


#: No pair of symbols, in the list of pair ranks.
NONE = 1 << 30
BITS = [1 << i for i in range(256)]


class Merger:
    """Merges the bytes of one pre-token at a time.

    The queue holds, by rank, the positions of pairs that are lower than both their neighbours
    (no other pair can be next, as a lower neighbour destroys it first). ``top`` and ``low`` are
    the two levels of the bitmap over ranks, in words of 256 bits.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.low = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        single = [ranks.get(bytes([i]), NONE) for i in range(256)]
        self.single = single
        self.bytes_pair = [ranks.get(bytes([i, j]), NONE) for i in range(256) for j in range(256)]
        self.pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << 24 | right] = rank

    def __call__(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, low, pair_of, two = len(piece), self.low, self.pairs.get, self.bytes_pair
        single, bits = self.single, BITS
        ids = [single[x] for x in piece]
        rank_at = [two[x << 8 | y] for x, y in zip(piece, piece[1:])]
        rank_at += (NONE, NONE)  # of the last symbol, and of the place before the first and after the last
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after.append(n)
        before.append(n - 1)
        buckets: dict[int, list[int]] = {}
        top, last = 0, NONE
        todo = []
        for i in range(n - 1):
            rank = rank_at[i]
            if rank < last and rank <= rank_at[i + 1]:
                todo.append(i)
            last = rank
        while True:
            for i in todo:
                rank = rank_at[i]
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [i]
                    w = rank >> 8
                    top |= bits[w] if w < 256 else 1 << w
                    low[w] |= bits[rank & 255]
                else:
                    heappush(bucket, i)
            if not top:
                break
            w = (top & -top).bit_length() - 1
            word = low[w]
            first = word & -word
            rank = (w << 8) + first.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[w] = word = word ^ first
                if not word:
                    top &= top - 1
            todo = []
            if rank_at[i] != rank:
                continue  # stale
            j = after[i]
            k = after[j]
            h = before[i]
            ids[i] = rank
            ids[j] = -1
            rank_at[j] = NONE
            after[i] = k
            if k < n:
                before[k] = i
                right = rank_at[i] = pair_of(rank << 24 | ids[k], NONE)
            else:
                right = rank_at[i] = NONE
            left = NONE
            if h >= 0:
                left = rank_at[h] = pair_of(ids[h] << 24 | rank, NONE)
                far = rank_at[before[h]]
                if left < far:
                    if left <= right and left < NONE:
                        todo.append(h)
                elif far < NONE and far <= left:
                    g = before[h]
                    if far < rank_at[before[g]]:
                        todo.append(g)
            if k < n:
                far = rank_at[k]
                if right <= far:
                    if right < left and right < NONE:
                        todo.append(i)
                elif far < NONE and far < right and far <= rank_at[after[k]]:
                    todo.append(k)
        return [x for x in ids if x >= 0]


class Remembered(dict):
    """Pre-token to its packed ids, computed when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.merge, self.older = Merger(ranks), {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.merge(piece.encode())
            packed = pack(f"<{len(ids)}I", *ids)
            if len(piece) > CACHED_CHARS:
                return packed
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class Encoder:
    def __init__(self, data: bytes, pattern: str):
        self.remembered, self.pattern = Remembered(load_ranks(data)), regex.compile(pattern)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        packed_of = self.remembered.__getitem__
        if len(text) < LONG_TEXT:
            return b"".join(map(packed_of, self.pattern.findall(text)))
        found, parts = (m.group() for m in self.pattern.finditer(text)), []
        while some := list(islice(found, 1 << 16)):
            parts.append(b"".join(map(packed_of, some)))
        return b"".join(parts)


class Decoder:
    def __init__(self, data: bytes):
        ranks = load_ranks(data)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def __call__(self, packed: bytes | None) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))


#: One encoder or decoder for each Python worker, kept between tasks (Spark runs chained UDFs in workers of their own).
_kept: dict[tuple, Encoder | Decoder] = {}


def _once(kind: type, *args):
    key = (kind, *args)
    if key not in _kept:
        _kept[key] = kind(*args)
    return _kept[key]


def broadcast_ranks(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:  # the vocabulary file is a parameter on the driver's disk
        data = f.read(MAX_RANK_FILE + 1)
    if len(data) > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than {MAX_RANK_FILE} bytes")
    return spark.sparkContext.broadcast(data)


def encode(df: DataFrame, ranks: Broadcast, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """Adds ``out_col``: the packed ids of each text."""
    bound_batches(df)

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _once(Encoder, ranks.value, pattern)
        for texts in batches:
            yield pa.array([encoder(t.as_py()) for t in texts], pa.binary())

    return df.withColumn(out_col, encoded(F.col(text_col)))


def decode(df: DataFrame, ranks: Broadcast, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``: the bytes that packed ids stand for (null ids: no bytes)."""
    bound_batches(df)

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _once(Decoder, ranks.value)
        for packed in batches:
            yield pa.array([decoder(p.as_py()) for p in packed], pa.binary())

    return df.withColumn(out_col, decoded(F.col(ids_col)))


def round_trip(df: DataFrame, ranks: Broadcast, pattern: str, text_col: str = "text", ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``encode``, then ``decode``, in one Python worker a task instead of two."""
    bound_batches(df)

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _once(Encoder, ranks.value, pattern), _once(Decoder, ranks.value)
        for texts in batches:
            ids = [encoder(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(decoder, ids), pa.binary())], ["ids", "decoded"])

    name = fresh(df, "both")
    out = df.withColumn(name, both(F.col(text_col)))
    return out.withColumns({ids_col: F.col(name)["ids"], out_col: F.col(name)["decoded"]}).drop(name)


def bpe_digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes, decodes and digests every text (the contract of ``op1``)."""
    ranks = broadcast_ranks(documents.sparkSession, path)
    out = round_trip(documents.select("doc_id", "text"), ranks, pattern)
    return out.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
