"""Token counts of a piece vocabulary (BPE with byte fallback) by rank-synchronous array merging.

Texts are split where no merge can cross (before a space mark that follows another
character, and around characters that no longer piece holds). The pre-tokens not seen
before are held together as ragged numpy arrays; each round applies the lowest-rank pair
of every sequence at once, and the symbols that survive are counted. A character outside
the vocabulary counts as its UTF-8 bytes.

Two cases need the order of single merges and apply one pair a round: ranks that several
pieces share, and a sequence where several merges of a round gave rise to a pair of lower
rank than theirs (it is counted again from its start).

Defined results: null and empty texts have 0 tokens. Long texts are handled piece by
piece. Other columns are kept; columns with the outputs' names are replaced. Rows are
independent, so repeated rows and empty tables need no care.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterspark.llm.common import bound_batches, chunks

#: A model file larger than this isn't broadcast.
MAX_MODEL_FILE = 64 << 20
#: Counts of pre-tokens remembered, twice so many at most; only of pre-tokens up to so many characters.
CACHED, CACHED_CHARS = 1 << 18, 64
#: Characters that are split at a time.
CHUNK = 1 << 21
MARK = "▁"
NONE = np.int64(1 << 40)


class PieceVocabulary:
    """Pieces and scores of a model file, as arrays."""

    def __init__(self, data: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = model.get_piece_size()
        self.pieces = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        score = np.array([model.get_score(i) for i in range(n)])
        self.char_id = np.full(0x110000, -1, np.int32)
        for piece, i in self.pieces.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
        rank_of_score = {s: r for r, s in enumerate(sorted({score[i] for i in self.pieces.values()}, reverse=True))}
        rank = {piece: rank_of_score[score[i]] for piece, i in self.pieces.items()}
        _, uses = np.unique([rank[p] for p in self.pieces if len(p) > 1], return_counts=True)
        self.shared = np.zeros(len(rank_of_score) + 1, bool)
        self.shared[np.unique([rank[p] for p in self.pieces if len(p) > 1])[uses > 1]] = True
        keys, ranks, merged = [], [], []
        inside, self.size = set(), n
        for piece, i in self.pieces.items():
            if len(piece) > 1:
                inside |= set(piece)
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece crosses a space; this split wouldn't be exact")
            for k in range(1, len(piece)):
                left, right = self.pieces.get(piece[:k]), self.pieces.get(piece[k:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    ranks.append(rank[piece])
                    merged.append(i)
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = (np.array(x, np.int64)[order] for x in (keys, ranks, merged))
        alone = re.escape("".join(c for c in map(chr, range(128)) if c not in inside and c != " "))
        self.split = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE: no piece) and merged ids of pairs."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NONE), self.merged[at]


def count_sequences(words: list[str], v: PieceVocabulary, single: bool = False) -> np.ndarray:
    """Tokens of each pre-token. single: one merge, the leftmost, a round."""
    counts = np.zeros(len(words), np.int64)
    if not words:
        return counts
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(w) for w in words])
    seq = np.repeat(np.arange(len(words)), lengths)
    sym = v.char_id[points]
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    np.add.at(counts, seq, np.where(sym < 0, width, 0))

    def ranks_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = np.minimum(at + 1, len(sym) - 1)
        r, m = v.pair(sym[at], sym[right])
        return np.where((seq[right] == seq[at]) & (right > at), r, NONE), m

    rank, merged = ranks_at(np.arange(len(sym)))
    before = np.full(len(words), -1, np.int64)  # rank of each sequence's last round with several merges
    again: set[int] = set()
    while len(sym):
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        ids = seq[starts]
        again.update(ids[(lowest < before[ids])].tolist())
        sizes = np.diff(np.r_[starts, len(seq)])
        done = lowest >= NONE
        if done.any():
            gone = np.repeat(done, sizes)
            np.add.at(counts, seq[gone], sym[gone] >= 0)
            sym, seq, rank, merged = sym[~gone], seq[~gone], rank[~gone], merged[~gone]
            lowest, sizes = lowest[~done], sizes[~done]
            if not len(sym):
                break
        each = np.repeat(lowest, sizes)
        at = np.flatnonzero(rank == each)
        first = np.r_[True, seq[at][1:] != seq[at][:-1]]
        if single:
            at = at[first]
        else:
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1] | first, np.arange(len(at)), 0))
            at = at[((np.arange(len(at)) - run) % 2 == 0) & (first | ~v.shared[rank[at]])]
            several = np.r_[False, seq[at][1:] == seq[at][:-1]]
            before[seq[at]] = -1
            before[seq[at][several]] = rank[at][several]
        sym[at] = merged[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, seq, rank, merged = sym[keep], seq[keep], rank[keep], merged[keep]
        now = (np.cumsum(keep) - 1)[at]
        now = np.unique(np.r_[now, now[now > 0] - 1])
        rank[now], merged[now] = ranks_at(now)
    if again:
        redo = sorted(again)
        counts[redo] = count_sequences([words[i] for i in redo], v, single=True)
    return counts


class TokenCounter:
    def __init__(self, data: bytes):
        self.v = PieceVocabulary(data)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        for a, b in chunks([len(t or "") for t in texts], CHUNK):
            if b == a + 1 and len(texts[a] or "") > CHUNK:
                out[a] = self._long(texts[a])
                continue
            words = [self.v.split.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[a:b]]
            self._learn(set().union(*words))
            count = self.known.__getitem__
            out[a:b] = [sum(map(count, w)) for w in words]
        return out

    def _long(self, text: str) -> int:
        total, some, size = 0, [], 0
        for m in self.v.split.finditer(MARK + text.replace(" ", MARK)):
            some.append(m.group())
            size += len(some[-1])
            if size > CHUNK:
                total, some, size = total + self._sum(some), [], 0
        return total + self._sum(some)

    def _sum(self, words: list[str]) -> int:
        self._learn(set(words))
        return sum(map(self.known.__getitem__, words))

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > CACHED:
            self.older, self.known = {w: n for w, n in self.known.items() if len(w) <= CACHED_CHARS}, {}
        new = []
        for w in words - self.known.keys():
            if (n := self.older.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = n
        self.known.update(zip(new, count_sequences(new, self.v).tolist()))


_counters: dict[bytes, TokenCounter] = {}


def broadcast_model(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:  # the model file is a parameter on the driver's disk
        data = f.read(MAX_MODEL_FILE + 1)
    if len(data) > MAX_MODEL_FILE:
        raise ValueError(f"{path} is larger than {MAX_MODEL_FILE} bytes")
    return spark.sparkContext.broadcast(data)


def count_tokens(df: DataFrame, model: Broadcast, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Adds ``out_col``: the number of tokens of each text. Other columns are kept."""
    bound_batches(df)

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        data = model.value
        if data not in _counters:
            _counters.clear()
            _counters[data] = TokenCounter(data)
        counter = _counters[data]
        for texts in batches:
            yield pa.array(counter(texts.to_pylist()), pa.int64())

    return df.withColumn(out_col, counted(F.col(text_col)))


def token_counts(documents: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Bytes, tokens and whether they exceed ``limit`` (the contract of ``op7``)."""
    out = count_tokens(documents.select("doc_id", "text"), broadcast_model(documents.sparkSession, path))
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
