"""Benchmark decontamination: an FM-index over each shard of the training text.

Words are runs of characters other than ASCII white space, punctuation and controls, with
A-Z in lower case. A window is 13 consecutive words of a benchmark item (a shorter item is
one window). A shard is a few MB of documents inside a task. Words that no item holds
can't be part of a window, so they only separate; runs of known words shorter than the
shortest window are left out, and the rest is indexed: suffix array, Burrows-Wheeler
transform as a wavelet matrix with rank counts, sampled suffix positions. All windows are
searched backward at once, their occurrences are located by walking to sampled positions,
and the covered words are merged into removal spans.

The benchmark is broadcast in blocks of bounded size; with several blocks the documents
are searched once for each and the spans are merged. The words of the benchmark alone
leave the driver, never anything of the corpus reaches it.

Defined results: a null or empty text has no words, spans or items. A benchmark row with
a null text or without words has no window; a row with a null id gives hits but is not
listed. Repeated benchmark rows count once, repeated documents each get their own result.
Empty tables work on either side. Other columns of the documents are kept; columns with
the outputs' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterspark.llm.common import bound_batches, chunks, fresh

WINDOW = 13
#: Bytes of benchmark text in a broadcast block.
BLOCK_BYTES = 16 << 20
#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Every so many positions of the indexed text are sampled.
SAMPLE = 8
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Windows:
    """The windows of a block of benchmark items over a small alphabet."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int = WINDOW):
        self.word_id: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item_id, text in items:
            ids = [self.word_id.setdefault(w, len(self.word_id) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                owners = found.setdefault(tuple(ids[i : i + size]), set())
                if item_id is not None:
                    owners.add(item_id)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # length: windows, their numbers
        self.owners = [sorted(x) for x in found.values()]
        for n in sorted({len(w) for w in found}):
            these = [(w, k) for k, w in enumerate(found) if len(w) == n]
            self.by_length[n] = np.array([w for w, _ in these], np.int64), np.array([k for _, k in these])
        self.shortest = min(self.by_length, default=0)


def suffix_array(symbols: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """By prefix doubling; separators differ from each other, in order of position."""
    n, m = len(symbols), int(separators.sum())
    rank = symbols + m
    rank[separators] = np.arange(m)
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank * (n + m + int(rank.max()) + 2)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2
        if step >= n:
            return order


class FMIndex:
    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE):
        """symbols: runs of ids from 1, each run ended by a 0."""
        n = len(symbols)
        ends = symbols == 0
        order = suffix_array(symbols.astype(np.int64), ends)
        last = symbols[order - 1]  # the Burrows-Wheeler transform
        self.last, self.first = last, np.r_[0, np.cumsum(np.bincount(symbols, minlength=alphabet + 1))]
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = last
        for bit in reversed(range(max(1, int(alphabet).bit_length()))):
            ones = (row >> bit) & 1
            counts = np.r_[0, np.cumsum(ones)].astype(np.int32)
            self.levels.append((bit, counts, n - int(counts[-1])))
            row = np.r_[row[ones == 0], row[ones == 1]]
        sampled = np.arange(n) % sample == 0
        sampled[0] = True
        sampled[1:] |= ends[:-1]  # the start of a run, so that no walk crosses a separator
        self.sampled = sampled[order]
        self.place = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before row ``at`` of the transform."""
        start = np.zeros_like(at)
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, s = ones[at], ones[start]
            at = np.where(one, zeros + a, at - a)
            start = np.where(one, zeros + s, start - s)
        return at - start

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``windows`` of those that occur, and their row ranges."""
        alive = np.arange(len(windows))
        tail = windows[:, -1]
        low, high = self.first[tail], self.first[tail + 1]
        for k in range(windows.shape[1] - 2, -1, -1):
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
            symbol = windows[alive, k]
            low = self.first[symbol] + self.rank(symbol, low)
            high = self.first[symbol] + self.rank(symbol, high)
        some = low < high
        return alive[some], low[some], high[some]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to sampled ones."""
        steps, out = np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            known = self.sampled[at]
            out[left[known]] = self.samples[self.place[at[known]]] + steps[left[known]]
            left = left[~known]
            at = rows[left]
            symbol = self.last[at]
            rows[left] = self.first[symbol] + self.rank(symbol, at)
            steps[left] += 1
        return out


def search_shard(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and window number of each occurrence in ``ids`` (0: a word that no item holds, or a document's end)."""
    empty = np.empty(0, np.int64)
    known = np.r_[False, ids > 0, False]
    edge = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= max(1, windows.shortest)
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return empty, empty, empty
    sizes = ends - starts + 1  # with a separator
    offset = np.r_[0, np.cumsum(sizes)]
    origin = np.arange(offset[-1]) - np.repeat(offset[:-1] - starts, sizes)
    symbols = ids[np.minimum(origin, len(ids) - 1)].astype(np.int64)
    symbols[offset[1:] - 1] = 0
    index = FMIndex(symbols, len(windows.word_id))
    found_start, found_end, found_window = [], [], []
    for n, (rows, numbers) in windows.by_length.items():
        which, low, high = index.search(rows)
        count = high - low
        if count.sum():
            row = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]] - low, count)
            at = origin[index.locate(row)]
            found_start.append(at)
            found_end.append(at + n)
            found_window.append(np.repeat(numbers[which], count))
    if not found_start:
        return empty, empty, empty
    return np.concatenate(found_start), np.concatenate(found_end), np.concatenate(found_window)


def _hits(texts: list[str | None], windows: Windows) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
    """Number of words, covered spans and items of each text of a shard."""
    get, parts, sizes = windows.word_id.get, [], []
    for t in texts:
        w = words_of(t)
        parts.append(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)))
        parts.append(np.zeros(1, np.int64))
        sizes.append(len(w))
    ids = np.concatenate(parts)
    base = np.r_[0, np.cumsum(np.array(sizes) + 1)]
    start, end, window = search_shard(ids, windows)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    hit = np.r_[False, np.cumsum(change) > 0]
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    lows, highs = edge[::2], edge[1::2]
    span_doc = np.searchsorted(base, lows, "right") - 1
    pairs = np.unique(np.stack([np.searchsorted(base, start, "right") - 1, window]), axis=1)
    a, b = np.searchsorted(span_doc, [np.arange(len(texts)), np.arange(1, len(texts) + 1)])
    c, d = np.searchsorted(pairs[0], [np.arange(len(texts)), np.arange(1, len(texts) + 1)])
    for k, n in enumerate(sizes):
        spans = list(zip((lows[a[k] : b[k]] - base[k]).tolist(), (highs[a[k] : b[k]] - base[k]).tolist()))
        yield n, spans, sorted({i for w in pairs[1, c[k] : d[k]] for i in windows.owners[w]})


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_TYPE = "struct<n_words: long, spans: array<struct<start: int, end: int>>, items: array<long>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.int64()))])


def find_contamination(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", out_col: str = "contamination", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds a struct: ``n_words``, ``spans`` (covered words, from and up to), ``items`` (ids of items with occurring windows)."""
    bound_batches(documents)
    context = documents.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // block_bytes))

    def searched(block):
        @F.arrow_udf(_TYPE)
        def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            windows = Windows(block.value)
            for batch in batches:
                texts, out = batch.to_pylist(), []
                for a, b in chunks([len(t or "") for t in texts], SHARD_BYTES):
                    out += _hits(texts[a:b], windows)
                yield pa.array([{"n_words": n, "spans": [{"start": s, "end": e} for s, e in spans], "items": ids} for n, spans, ids in out], _ARROW)

        return search

    @F.arrow_udf(_TYPE)
    def merged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            out = []
            for x, y in zip(one.to_pylist(), two.to_pylist()):
                spans = _union([(s["start"], s["end"]) for s in x["spans"] + y["spans"]])
                out.append({"n_words": x["n_words"], "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted({*x["items"], *y["items"]})})
            yield pa.array(out, _ARROW)

    out, other = documents, fresh(documents, "block")
    for k in range(blocks):  # a bounded block each time, never the whole of a large benchmark
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        found = searched(context.broadcast([tuple(r) for r in rows]))(F.col(text_col))
        out = out.withColumn(out_col if k == 0 else other, found)
        if k:
            out = out.withColumn(out_col, merged(F.col(out_col), F.col(other))).drop(other)
    return out


def decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hits, items and the verdict for every document (the contract of ``op10``)."""
    found = find_contamination(documents.select("doc_id", "text"), benchmark).select("doc_id", "contamination.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, unchanged."""
    name = fresh(documents, "found")
    found = find_contamination(documents, benchmark, out_col=name)
    n_hit = F.aggregate(F.col(name)["spans"], F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col(name)["n_words"]))).drop(name)
