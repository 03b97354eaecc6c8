"""Removal of byte strings that start at two places or more, through suffix arrays.

Rule: every byte covered by a 200-byte string that also starts anywhere else (in any
document, the same one included; overlaps count) is removed, judged on the input.

1. Anchors. In each 200-byte window the 32-byte piece of least hash is the window's
   anchor (the leftmost of equal ones). Equal windows have equal anchors at equal offsets,
   so only anchors whose hash occurs twice or more in the corpus can matter; they are
   counted by a partial aggregation. Each window start has one anchor, so an anchor is
   responsible for a range of starts; the bytes of these windows are its context.
2. Contexts of repeated anchors are aggregated by content: a context that thousands of
   documents share is one row with a weight.
3. Suffix arrays. The contexts of an anchor are cut into 16-byte blocks aligned to the
   anchor and concatenated, each ended by its own terminator. Their suffixes are sorted by
   linear grouping: suffixes are grouped by their Lyndon prefix, groups are processed in
   descending order with previous-smaller pointers, and then each group's order is
   emitted; no names are assigned recursively. Neighbours that share eleven blocks or more
   form classes: any two equal 200-byte windows share eleven whole blocks, so equal
   windows are members of a class. Inside a class the 24 bytes that the blocks leave open
   are compared exactly.
4. An anchor that stands at many places may have too many contexts for one suffix array.
   Its contexts are cut by the offset of the window from the anchor into ranges of 64
   offsets, and dealt by the bytes that all windows of a range share, so equal windows
   always meet in one group. Groups that are still too large are cut again, into ranges of
   16, 4 and 1 offsets; a group of one offset holds one window only. Groups with one
   occurrence hold nothing repeated and go.
5. The repeated window starts go back to the documents by content hash, become spans, and
   the spans are cut out.

Contexts are told apart by 128-bit hashes of their bytes.

Defined results: null and empty texts have nothing removed. Texts shorter than 200 bytes
are kept. Repeated rows make each other repeated. An empty table gives an empty table.
Rows with a null id are treated like others. Other columns are kept under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterspark.llm.common import KEY, bound_batches, fresh, publish, publish_bucketed, row_key

LENGTH = 200
GRAM = 32
#: Window starts that see an anchor.
REACH = LENGTH - GRAM
BLOCK = 16
SHARED_BLOCKS = (LENGTH - BLOCK + 1) // BLOCK  # whole blocks in any window, wherever it starts
#: Contexts of one suffix array's group at most; anchors at more places are dealt out by the bytes around them.
PART = 512
#: Offsets of a range at each further cut.
WIDTHS = (64, 16, 4, 1)
#: Blocks in one suffix array.
ARRAY_BLOCKS = 1 << 16
#: Bytes hashed at a time.
CHUNK = 1 << 18

_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK + 4 * LENGTH, _MUL)], dtype=np.uint64)
_BACK = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK + 4 * LENGTH, _INV)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each ``size`` bytes of ``data`` (at most CHUNK + 4 LENGTH bytes)."""
    n = len(data)
    if n < size:
        return np.empty(0, np.uint64)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _POW[:n], out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * _BACK[: n - size + 1])


_BYTE = _mix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` consecutive hashes, the leftmost of equal ones."""
    value, at, size = h, np.arange(len(h)), 1
    while size < width:
        step = min(size, width - size)
        right = value[step:] < value[:-step]
        at = np.where(right, at[step:], at[:-step])
        value = np.where(right, value[step:], value[:-step])
        size += step
    return at


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and hash of each anchor, and the first and last window start that it is responsible for."""
    n = len(data) - LENGTH + 1  # window starts
    none = np.empty(0, np.int64)
    if n < 1:
        return none, np.empty(0, np.uint64), none, none
    at, hashes = [], []
    for a in range(0, n, CHUNK):
        part = data[a : min(a + CHUNK, n) + LENGTH - 1]
        h = window_hashes(part, GRAM)
        found = _leftmost_least(h, REACH + 1)
        at.append(found + a)
        hashes.append(h[found])
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], hashes[first], first, np.r_[first[1:], n] - 1


def _bytes(text: str | bytes | None) -> np.ndarray:
    return np.frombuffer(text.encode() if isinstance(text, str) else text or b"", np.uint8)


def sort_suffixes(symbols: list[int]) -> list[int]:
    """The suffix array of ``symbols``, whose last must be the least and unique, by linear grouping.

    Phase 1 gives each suffix the group of its Lyndon prefix. Groups are processed in
    descending order; ``prev`` holds the previous-smaller pointer of a suffix, found by
    following pointers of suffixes already taken. The suffixes before a group's members move
    to new groups right above those that they were in, by how many members point to them.
    Phase 2 emits the order: the suffix before an emitted one takes the next place of its
    group.
    """
    n = len(symbols)
    if n < 2:
        return list(range(n))
    starts_of: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        starts_of.setdefault(s, []).append(i)
    # A group is [place of its first suffix]; members sit in ``order`` at first .. first + size - 1.
    order, place = [0] * n, [0] * n
    group_of, size_of = [0] * n, [0] * n  # by suffix: first place of its group; by first place: size
    firsts = []
    p = 0
    for s in sorted(starts_of):
        members = starts_of[s]
        firsts.append(p)
        size_of[p] = len(members)
        for k, i in enumerate(members, p):
            order[k] = i
            place[i] = k
            group_of[i] = p
        p += len(members)
    prev = [-2] * n  # -2: not known yet, -1: none
    end = n
    while end > 0:
        first = group_of[order[end - 1]]
        members = order[first:end]
        # previous smaller suffix of each member: the nearest before it that isn't in this or a higher group
        pointed: dict[int, int] = {}
        for i in sorted(members):
            j = i - 1
            while j >= 0 and group_of[j] >= first:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        # suffixes pointed to more often have the longer repetition and end up higher in their group
        by_count: dict[int, list[int]] = {}
        for j, count in pointed.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_count[count]:
                moved.setdefault(group_of[j], []).append(j)
            for g, js in moved.items():
                size = size_of[g]
                top = g + size
                for j in js:  # to the end of the group, which then ends before them
                    top -= 1
                    k, other = place[j], order[top]
                    order[k], place[other] = other, k
                    order[top], place[j] = j, top
                size_of[g] = size - len(js)
                size_of[top] = len(js)
                for j in js:
                    group_of[j] = top
        size_of[first] = end - first
        end = first
    # phase 2
    out = [-1] * n
    next_of = list(range(n))
    taken = [False] * n
    queue_last = n - 1  # the last suffix is the least of its group as nothing follows it
    out[group_of[queue_last]] = queue_last
    next_of[group_of[queue_last]] += 1
    taken[queue_last] = True
    for k in range(n):
        i = out[k]
        j = i - 1
        while j >= 0 and not taken[j]:
            g = group_of[j]
            out[next_of[g]] = j
            next_of[g] += 1
            taken[j] = True
            j = prev[j]
    return out


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number."""
    return np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), strides=(1,))


def repeated_starts(contexts: list[bytes], offsets: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Repeated windows among contexts, by a suffix array over their anchor-aligned blocks.

    offsets: of the first byte of each context from its anchor. Returns ranges ``(context, first start, last start)``.
    """
    sizes = np.array([len(c) for c in contexts])
    base = np.r_[0, np.cumsum(sizes)]
    data = np.frombuffer(b"".join(contexts), np.uint8)
    lead = (-offsets) % BLOCK  # bytes before the first aligned block
    blocks = np.maximum(0, (sizes - lead) // BLOCK)
    which = np.repeat(np.arange(len(contexts)), blocks)
    number = np.arange(len(which)) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
    byte = base[which] + lead[which] + BLOCK * number
    rows = np.ascontiguousarray(data[byte[:, None] + np.arange(BLOCK)])
    _, ids = np.unique(rows.view("<u8").reshape(-1, 2), axis=0, return_inverse=True) if len(rows) else (None, np.empty(0, np.int64))
    # blocks of each context, then its terminator; the last terminator is the least symbol
    place = np.arange(len(which)) + which
    symbols = np.empty(len(which) + len(contexts), np.int64)
    symbols[place] = ids.reshape(-1) + len(contexts) + 1
    ends = np.cumsum(blocks + 1) - 1
    symbols[ends] = np.arange(len(contexts), 0, -1)
    order = np.array(sort_suffixes(symbols.tolist()))
    block_at = np.full(len(symbols), -1)
    block_at[place] = np.arange(len(which))
    left = np.minimum(np.repeat(ends, blocks + 1), len(symbols) - 1) - np.arange(len(symbols))  # blocks up to the terminator
    order = order[left[order] >= SHARED_BLOCKS]
    if not len(order):
        return []
    same = np.ones(len(order) - 1, bool)
    for k in range(SHARED_BLOCKS):
        same &= symbols[order[1:] + k] == symbols[order[:-1] + k]
    classes = np.cumsum(np.r_[True, ~same])
    # the windows that begin in the block before each suffix
    at = block_at[order]
    start = (byte[at] - base[which[at]])[:, None] - np.arange(BLOCK)
    context = np.broadcast_to(which[at][:, None], start.shape)
    valid = (start >= 0) & (start + LENGTH <= sizes[context])
    start, context = start[valid], context[valid]
    if not len(start):
        return []
    turn = np.broadcast_to(np.arange(BLOCK), valid.shape)[valid]
    group = np.broadcast_to(classes[:, None], valid.shape)[valid] * BLOCK + turn
    # a class shares the blocks; at most 15 bytes before them and 24 after them are open
    words, at = _words(data), base[context] + start
    edges = [words[at + k] for k in (0, 8, LENGTH - 24, LENGTH - 16, LENGTH - 8)]
    h = _mix(edges[0])
    for e in edges[1:]:
        h = _mix(h + e)
    by = np.lexsort((h, group))
    new = (group[by][1:] != group[by][:-1]) | (h[by][1:] != h[by][:-1])
    if any((~new & (e[by][1:] != e[by][:-1])).any() for e in edges):  # equal hashes of different bytes
        by = np.lexsort((*edges, group))
        new = group[by][1:] != group[by][:-1]
        for e in edges:
            new |= e[by][1:] != e[by][:-1]
    new = np.r_[True, new]
    start, context = start[by], context[by]
    total = np.add.reduceat(weights[context], np.flatnonzero(new))
    twice = (total >= 2)[np.cumsum(new) - 1]
    context, start = context[twice], start[twice]
    if not len(start):
        return []
    by = np.lexsort((start, context))
    context, start = context[by], start[by]
    cut = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[cut[1:], len(start)] - 1
    return list(zip(context[cut].tolist(), start[cut].tolist(), start[last].tolist()))


_ANCHORS = "_k0 long, _k1 long, h long, pack long"
#: Contexts (or cuts of them): group, hash, offset of the first byte from the anchor, bytes and weight.
_CONTEXTS = "grp long, ctx binary, s0 int, bytes binary, n long"
_FOUND = "ctx binary, lo int, hi int"


def _digest(s0: int, data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data, seed=s0 + LENGTH)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 100):
            part = batch.slice(k, 100)
            found = [anchors(_bytes(t.as_py())) for t in part.column("text")]
            n = [len(x[0]) for x in found]
            if not sum(n):
                continue
            at, h, first, last = (np.concatenate([x[i] for x in found]) for i in range(4))
            pack = (at << 16) | ((at - first) << 8) | (last - first)
            keys = [pa.array(np.repeat(part.column(c).to_numpy(), n)) for c in KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(h.view(np.int64)), pa.array(pack)], ["_k0", "_k1", "h", "pack"])


_PLACED = pa.schema([("_k0", pa.int64()), ("_k1", pa.int64()), ("first", pa.int32()), ("hot", pa.bool_()), ("grp", pa.int64()), ("ctx", pa.binary()), ("s0", pa.int32()), ("bytes", pa.binary())])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The context of each repeated anchor of a document, with the document's key and the context's first byte in it."""
    out: list[tuple] = []
    size = 0
    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in KEY]
        packs = batch.column("packs")
        ends, flat = packs.value_lengths().to_numpy(zero_copy_only=False).cumsum(), packs.flatten()
        h, pack, hot = (flat.field(c) for c in ("h", "pack", "hot"))
        pack = pack.to_numpy()
        before = (pack >> 8 & 255).astype(np.int64)
        firsts, sizes = (pack >> 16) - before, (pack & 255) + LENGTH
        h, hot, before, firsts, lasts = h.to_pylist(), hot.to_pylist(), before.tolist(), firsts.tolist(), (firsts + sizes).tolist()
        at = 0
        for k0, k1, text, end in zip(*keys, batch.column("text"), ends.tolist()):
            data = text.as_py().encode()
            for i in range(at, end):
                cut = data[firsts[i] : lasts[i]]
                out.append((k0, k1, firsts[i], hot[i], h[i], _digest(-before[i], cut), -before[i], cut))
                size += len(cut)
            at = end
            if size > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PLACED)], schema=_PLACED)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PLACED)], schema=_PLACED)


def _pieces(width: int):
    """Cuts of contexts by the offset of the window from the anchor; ``grp`` tells the bytes that all windows of a cut's range share."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ctx, s0, data, n in zip(*(batch.column(c).to_pylist() for c in ("ctx", "s0", "bytes", "n"))):
                last = -s0  # offset of the first window, the largest; the last window has the least
                least = last - (len(data) - LENGTH)
                for k in range(least // width, last // width + 1):
                    ends = k * width + width - 1  # offsets of the range: k * width to ends
                    lo, hi = max(0, last - ends), min(len(data) - LENGTH, last - k * width)
                    piece = data[lo : hi + LENGTH]
                    core = data[last - k * width : last - ends + LENGTH]
                    grp = xxhash.xxh3_64_intdigest(core, seed=k * LENGTH + width) - (1 << 63)
                    out.append((ctx, lo, grp, _digest(s0 + lo, piece), s0 + lo, piece, n))
            if out:
                cols = list(zip(*out))
                kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["whole", "shift", "grp", "ctx", "s0", "bytes", "n"])

    return cut


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; whole groups are gathered up to the size of one suffix array.

    All windows of one context differ, as they have their anchor at different offsets: a group of a single
    context needs no array.
    """

    def rows_of(found: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        out = zip(*found) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int32(), pa.int32()))], ["ctx", "lo", "hi"])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        _, ids, offsets, contexts, weights = zip(*rows)
        return rows_of([(ids[c], a, b) for c, a, b in repeated_starts(list(contexts), np.array(offsets), np.array(weights))])

    waiting: list[tuple] = []
    size = first = 0  # blocks waiting; where the last group begins
    alone: list[tuple[bytes, int, int]] = []

    def close() -> None:
        nonlocal size
        if len(waiting) == first + 1:
            _, ctx, _, data, n = waiting.pop()
            size -= len(data) // BLOCK + 1
            if n > 1:
                alone.append((ctx, 0, len(data) - LENGTH))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "ctx", "s0", "bytes", "n"))):
            if waiting and waiting[-1][0] != row[0]:
                close()
                first = len(waiting)
                if size >= ARRAY_BLOCKS:
                    yield solve(waiting)
                    waiting.clear()
                    size = first = 0
            waiting.append(row)
            size += len(row[3]) // BLOCK + 1
        yield rows_of(alone)
        alone.clear()
    if waiting:
        close()
    yield rows_of(alone)
    if waiting:
        yield solve(waiting)


def _cut(text: str | None, spans: list[tuple[int, int]] | None) -> tuple[bytes, int, int]:
    """The bytes that stay, and the numbers of removed bytes and runs."""
    data = (text or "").encode()
    merged: list[list[int]] = []
    for a, b in sorted(spans or []):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), sum(b - a for a, b in merged), len(merged)


def _cut_characters(text: str, spans: list[tuple[int, int]]) -> str:
    """Like _cut, with each removed run shrunk to whole characters, so that valid text stays."""
    data = text.encode()
    inner = []
    for a, b in spans:
        inner.append((a, b))
    merged: list[list[int]] = []
    for a, b in sorted(inner):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    kept, at = [], 0
    for a, b in merged:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = max(a, b)
    kept.append(data[at:])
    return b"".join(kept).decode()


def _searched(contexts: DataFrame) -> DataFrame:
    """``(ctx, lo, hi)``: ranges of repeated windows of contexts whose groups are small."""
    rows = contexts.select("grp", "ctx", "s0", "bytes", "n")
    return rows.repartition("grp").sortWithinPartitions("grp", "ctx").mapInArrow(_search, _FOUND)


def _dealt(contexts: DataFrame, part: int, widths: tuple[int, ...]) -> DataFrame:
    """``(ctx, lo, hi)`` of contexts whose groups may be large: cut, dealt by what the cuts' windows share, and cut again."""
    pieces = publish(contexts.mapInArrow(_pieces(widths[0]), f"whole binary, shift int, {_CONTEXTS}"))
    distinct = publish(pieces.groupBy("ctx").agg(F.sum("n").alias("n"), *(F.any_value(c).alias(c) for c in ("grp", "s0", "bytes"))))
    sizes = publish(distinct.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where("w > 1").select("grp", "m"))
    grouped = publish(distinct.join(sizes, "grp"))
    found = _searched(grouped.where(F.col("m") <= part))
    large = grouped.where(F.col("m") > part).drop("m")
    if len(widths) > 1 and not large.isEmpty():
        found = found.unionByName(_dealt(large, part, widths[1:]))
    back = pieces.select("whole", "shift", "ctx").join(publish(found), "ctx")
    return back.select(F.col("whole").alias("ctx"), (F.col("shift") + F.col("lo")).alias("lo"), (F.col("shift") + F.col("hi")).alias("hi"))


def find_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """``(_k0, _k1, text, spans)`` of the documents with repeated strings; spans are byte ranges, possibly overlapping."""
    bound_batches(documents)
    docs = documents.select(*row_key(id_col, text_col), F.col(text_col).alias("text")).where("octet_length(text) >= %d" % LENGTH)
    found = publish(docs.mapInArrow(_anchor_rows, _ANCHORS))
    repeated = publish(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h", (F.col("c") > part).alias("hot")))
    packs = found.join(repeated, "h").groupBy(*KEY).agg(F.collect_set(F.struct("h", "pack", "hot")).alias("packs"))
    candidates = publish_bucketed(docs, packs, KEY)  # whole texts move once

    contexts = candidates.mapInArrow(_contexts, "_k0 long, _k1 long, first int, hot boolean, grp long, ctx binary, s0 int, bytes binary")
    distinct = publish(contexts.groupBy("ctx").agg(F.count("*").alias("n"), *(F.any_value(c).alias(c) for c in ("hot", "grp", "s0", "bytes"))))
    ranges = _searched(distinct.where("not hot"))
    hot = distinct.where("hot")
    if not hot.isEmpty():
        ranges = ranges.unionByName(_dealt(hot, part, WIDTHS))
    ranges = publish(ranges.groupBy("ctx").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))

    places = contexts.select(*KEY, "first", "ctx").join(ranges, "ctx")
    places = places.select(*KEY, F.expr("transform(ranges, r -> struct(first + r.lo as a, first + r.hi + %d as b))" % LENGTH).alias("spans"))
    spans = places.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return candidates.select(*KEY, "text").join(publish(spans), KEY)


def suffix_digests(documents: DataFrame) -> DataFrame:
    """What is removed from each document, and the hash of the rest (the contract of ``op8``)."""

    @F.arrow_udf("struct<kept: binary, n_removed: long, n_spans: long>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
        for texts, spans in batches:
            out = [_cut(t.as_py(), [(x["a"], x["b"]) for x in s.as_py()]) for t, s in zip(texts, spans)]
            yield pa.array([{"kept": k, "n_removed": r, "n_spans": n} for k, r, n in out], kind)

    found = find_repeats(documents).withColumn("c", cut("text", "spans"))
    found = found.select(*KEY, "c.n_removed", "c.n_spans", F.sha2("c.kept", 256).alias("kept")).dropDuplicates(KEY)
    text = F.coalesce("text", F.lit(""))
    docs = documents.select("doc_id", *row_key("doc_id", "text"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("all"))
    return docs.join(publish(found), KEY, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "all").alias("kept_sha256"),
    )


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated strings cut out of ``text_col``; a run that begins or ends inside a character keeps that character."""

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield pa.array([_cut_characters(t.as_py(), [(x["a"], x["b"]) for x in s.as_py()]) for t, s in zip(texts, spans)], pa.string())

    k0, k1, out = fresh(documents, "k0"), fresh(documents, "k1"), fresh(documents, "cut")
    found = find_repeats(documents, id_col, text_col).select(*KEY, cut("text", "spans").alias(out)).dropDuplicates(KEY)
    keys = [c.alias(k) for c, k in zip(row_key(id_col, text_col), (k0, k1))]
    joined = documents.select("*", *keys).join(publish(found).withColumnsRenamed(dict(zip(KEY, (k0, k1)))), [k0, k1], "left")
    return joined.withColumn(text_col, F.coalesce(out, text_col)).select(*documents.columns)
