"""Main text of web pages: nearest-URL page differencing.

A page is cut into text lines at block tags. Pages of a host with equal html are one page
(of least path and query), whose text goes to all of them. Pages of a host are ordered by
URL path and query; each is compared with the neighbour whose path shares the longest
beginning, their lines are aligned by a longest common subsequence (bit-parallel), and
shared lines are deleted (for the deletion, only lines that structure leaves open are
aligned). A neighbour that shares most of a page's text is a copy of it and
tells nothing: a chain of adjacent copies is a group, and the neighbours of its pages are the
pages next to the group.

Lines inside an ``article`` or ``main`` element stay even if a neighbour shares them, as
articles quote each other. What differencing can't see, as each page has its own, is told by
structure: lines inside menus, headers, footers, sidebars, forms, hidden elements and other
elements that never hold an article go, as do reader comments (elements named so that don't
hold the first article, nested articles too), and lines inside elements whose class, id or role names them
as adverts, notices, menus and the like, in an article as outside, unless the element holds an
article or the page had no text of its own left; a page without an article keeps named
elements that hold more than the rest of it.

Differencing runs on line hashes with their sizes, a few bytes a line: these are sorted into
contiguous ranges, however many pages a host has, and a task streams through its range with
three pages in memory. Pages at the ends of ranges, groups of copies and the pages next to
them are left open; they are few, and their neighbours are found by their numbers
afterwards. Only the numbers of deleted lines go back to the pages, by host and content.

Defined results: null and empty html gives an empty text. A null URL, or one without a
host, has no neighbours. Repeated rows are copies of each other. Unclosed tags end where
their parents end; an unclosed boilerplate element hides nothing. Very long pages have no
cap; the alignment takes memory in proportion to their lines. An empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from letterspark.llm.common import bound_batches, publish
from letterspark.plans.prefix import running_sum

#: A neighbour with this share of a page's text in common is a copy.
COPY = 0.6
#: Bits of an alignment kept at once; longer pages are halved first.
ALIGNED = 1 << 24

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
HIDDEN = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "svg", "object", "fieldset", "audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Words of boilerplate in class, id and role names, as whole names or as parts between hyphens and underscores.
MARKED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "complementary", "consent", "contentinfo", "cookie", "cookies", "footer", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "related", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "widget",
}
#: Whole names of reader comments.
COMMENTS = {"comment", "comments", "comment-list", "commentlist", "comments-area", "comment-section", "comments-section", "user-comments", "reader-comments", "disqus", "disqus_thread", "replies"}
UNSEEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s/=]|$)|style\s*=\s*(?:"[^"]*|'[^']*|)(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ARTICLE = ("article", "main")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, rest): kind is ``text``, ``open`` or ``close``; raw elements are left out with their contents."""
    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            break
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            yield "close", tag, ""
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, at)
            if end:
                at = end.end()
            yield "break", tag, ""
        else:
            yield "open", tag, m[3] or m[6] or ""
    if at < n:
        yield "text", "", html[at:]


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """Text lines of a page in order, each with 0 (plain), 1 (inside boilerplate) or 2 (inside the article).

    Lines that only the name of an element marks are boilerplate if other text is left: in an article any, on a page
    without one as much as they hold themselves. Otherwise they are as plain as others, and differencing decides.
    """
    tokens = list(_tokens(html or ""))
    close_of: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    for k, (kind, tag, _) in enumerate(tokens):
        if kind == "open" and tag not in VOID:
            open_at.setdefault(tag, []).append(k)
        elif kind == "close" and open_at.get(tag):
            close_of[open_at[tag].pop()] = k
    articles = [k for k, (kind, tag, _) in enumerate(tokens) if kind == "open" and tag in ARTICLE and k in close_of]
    out: list[tuple[str, int, bool]] = []  # line, state, told by a name alone
    parts: list[str] = []
    hidden_until = named_until = article_until = -1

    def flush(k: int) -> None:
        line = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if line:
            out.append((line, 1 if k <= hidden_until else 2 if k <= article_until else 0, hidden_until < k <= named_until))

    def judge(k: int, tag: str, rest: str, end: int) -> str:
        """``hidden``, ``named`` or nothing."""
        inside = k <= article_until
        names = {x.lower() for m in NAMES.finditer(rest) for x in (m[1] or m[2] or m[3] or "").split()} if rest else set()
        if not names.isdisjoint(COMMENTS) and tag not in ("html", "body") and not (articles and k <= articles[0] < end):
            return "hidden"
        at = bisect_right(articles, k)
        if tag in ARTICLE or at < len(articles) and articles[at] < end:
            return ""
        if tag in HIDDEN and (tag != "header" or not inside) or rest and UNSEEN.search(rest):
            return "hidden"
        words = names | {w for x in names for w in re.split("[-_]+", x)}
        return "named" if tag not in ("html", "body") and not words.isdisjoint(MARKED) else ""

    for k, (kind, tag, rest) in enumerate(tokens):
        if kind == "text":
            parts.append(rest)
            continue
        if kind == "break" or tag in BLOCK or k in (hidden_until, named_until):
            flush(k)
        if kind == "open" and k > hidden_until:
            end = close_of.get(k, -1)
            found = judge(k, tag, rest, end) if end > 0 else ""
            if found:
                flush(k)
            if found == "hidden":
                hidden_until = end
            elif found:
                named_until = max(named_until, end)
            elif tag in ARTICLE:
                article_until = max(article_until, end)
    flush(len(tokens))
    size = lambda want: sum(len(line) for line, state, named in out if state != 1 and want(state, named))
    others, article = size(lambda s, named: not named), size(lambda s, named: s == 2 and not named)
    drop = article > 0 or others > 0 and (any(s == 2 for _, s, _ in out) or others >= size(lambda s, named: named))
    return [(line, 1 if named and drop else state) for line, state, named in out]


def _bits(a: list, b: list) -> Iterator[int]:
    """Bit rows of the alignment of ``a`` with ``b``: a zero bit j where the common length grows at b[j]."""
    places: dict = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    yield v
    for line in a:
        u = v & places.get(line, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``."""
    for v in _bits(a, b):
        last = v
    ones = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - ones.astype(np.int64))]


def _align(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; memory in proportion to their lengths."""
    if not a or not b:
        return []
    if len(a) * len(b) > ALIGNED and len(a) > 1:
        half = len(a) // 2
        at = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _align(a[:half], b[:at]) + [half + k for k in _align(a[half:], b[at:])]
    rows, out = list(_bits(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        elif a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        else:
            j -= 1
    return out[::-1]


def shared(a: list, b: list) -> list[bool]:
    """Which lines of ``a`` are in its longest common subsequence with ``b``."""
    keep = [False] * len(a)
    in_a, in_b = set(a), set(b)
    at = [i for i, x in enumerate(a) if x in in_b]
    for k in _align([a[i] for i in at], [x for x in b if x in in_a]):
        keep[at[k]] = True
    return keep


LINE = np.dtype([("h", "<u8"), ("n", "<u4"), ("s", "u1")])


def _pack(lines: list[tuple[str, int]]) -> bytes:
    """Hash, size and state of each line."""
    return np.array([(xxhash.xxh3_64_intdigest(t), len(t), s) for t, s in lines], LINE).tobytes()


def _unpack(value: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Hashes, sizes and states."""
    x = np.frombuffer(value, LINE)
    return x["h"].tolist(), x["n"].astype(np.int64), x["s"]


Page = tuple[list[int], np.ndarray, np.ndarray]


def compare(page: Page, other: Page) -> tuple[np.ndarray, bool]:
    """The lines that ``page`` shares with ``other``, and whether that is a copy of it: told by the lines of the article, where there are some, else by the plain lines."""
    found = np.array(shared(page[0], other[0]), bool)
    judged = page[2] == (2 if (page[2] == 2).any() else 0)
    return found, bool(page[1][judged & found].sum() > COPY * page[1][judged].sum())


def difference(page: Page, neighbours: list[Page]) -> list[int]:
    """Numbers of the plain lines that go, aligned without the lines that stay or go anyway; the nearest neighbour comes first."""
    plain = np.flatnonzero(page[2] == 0)
    for other in neighbours if len(plain) else ():
        if not compare(page, other)[1]:
            found = shared([page[0][k] for k in plain], other[0])
            return plain[np.array(found, bool)].tolist()
    return []


def kept_text(lines: list[tuple[str, int]], gone: list[int]) -> str:
    out = set(gone)
    return " ".join(t for k, (t, s) in enumerate(lines) if s == 2 or s == 0 and k not in out)


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _nearest(page: tuple, near: list[tuple]) -> list[int]:
    """Deleted lines of a page (path, lines) by its neighbours (the one before first)."""
    near = sorted(near, key=lambda x: -_common(page[0], x[0]))
    return difference(page[1], [x[1] for x in near])


def _out(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows that end in their size."""
    out: list[tuple] = []
    total = 0
    for *row, n in rows:
        out.append(tuple(row))
        total += n
        if total > size or len(out) == 10000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
            out, total = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


GONE = pa.list_(pa.int32())
RANGED = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("h0", pa.int64()), ("h1", pa.int64()), ("open", pa.bool_()), ("follows", pa.bool_()), ("gone", GONE), ("lines", pa.binary())])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host, path and query. ``open`` rows aren't judged yet; ``follows``: in a group with the page before."""
    part = TaskContext.get().partitionId()
    names = ("host", "path", "h0", "h1")

    def pages() -> Iterator[tuple]:
        for batch in batches:
            for *row, lines in zip(*(batch.column(c) for c in (*names, "lines"))):
                packed = lines.as_py()
                yield (*(x.as_py() for x in row), packed, _unpack(packed))

    def copies(x: tuple, y: tuple) -> bool:
        return x[0] == y[0] and (compare(x[-1], y[-1])[1] or compare(y[-1], x[-1])[1])

    def rows() -> Iterator[tuple]:
        # open: in a group, or at an end of the range; kept: open, next to a group, or second at an end
        held: list[list] = []  # page, follows

        def settle(k: int, no: int) -> tuple:
            page, follows = held[k]
            before = held[k - 1] if k else None
            after = held[k + 1] if k + 1 < len(held) else None
            open_ = bool(before is None or after is None or follows or after[1])
            keep = open_ or no < 2 or k + 2 >= len(held) or before[1] or held[k + 2][1]
            gone = None
            if not open_:
                gone = _nearest((page[1], page[-1]), [(x[0][1], x[0][-1]) for x in (before, after) if x[0][0] == page[0]])
            return part, no, *page[:4], open_, follows, gone, page[4] if keep else None, len(page[4]) + 100

        no = at = 0  # at: the place in ``held`` of the next page to settle
        for page in pages():
            held.append([page, bool(held) and copies(held[-1][0], page)])
            if len(held) - at > 2:
                yield settle(at, no)
                no, at = no + 1, at + 1
                if at > 1:
                    del held[0]
                    at -= 1
        while at < len(held):
            yield settle(at, no)
            no, at = no + 1, at + 1

    yield from _out(rows(), RANGED)


PLACED = pa.schema([("host", pa.string()), ("h0", pa.int64()), ("h1", pa.int64()), ("gone", GONE)])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deleted lines of open pages, which come with the pages before (a) and after (b) their groups."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for *row, path, lines, a_path, a_lines, b_path, b_lines in zip(*(batch.column(c) for c in ("host", "h0", "h1", "path", "lines", "a_path", "a_lines", "b_path", "b_lines"))):
                near = [(p.as_py(), _unpack(x.as_py())) for p, x in ((a_path, a_lines), (b_path, b_lines)) if x.is_valid]
                gone = _nearest((path.as_py(), _unpack(lines.as_py())), near)
                yield *(x.as_py() for x in row), gone, len(gone) + 100

    yield from _out(rows(), PLACED)


@F.arrow_udf(BooleanType())
def _copies(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([compare(x, y)[1] or compare(y, x)[1] for x, y in ((_unpack(x.as_py()), _unpack(y.as_py())) for x, y in zip(a, b))], pa.bool_())


def _place_open(ranged: DataFrame) -> DataFrame:
    """Deleted lines of the open pages: pages are numbered over all ranges, and groups that go on in the next range are joined."""
    kept = ranged.where("lines is not null")
    # one row a range: its number of pages (its last page is always kept) and the pages before it
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = publish(kept.groupBy("part").agg((F.max("no") + 1).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))))
    kept = kept.join(F.broadcast(sizes), "part").withColumn("pos", F.col("base") + F.col("no"))
    last = kept.where("no = n - 1").select((F.col("pos") + 1).alias("pos"), "host", F.col("lines").alias("_lines"))
    joined = kept.where("no = 0").select("pos", "host", "lines").join(last, ["pos", "host"]).where(_copies("_lines", "lines")).select("pos", F.lit(True).alias("_joined"))
    narrow = kept.select("part", "pos", "open", "follows").join(publish(joined), "pos", "left").withColumn("start", F.when(F.col("follows") | F.col("_joined").isNotNull(), 0).otherwise(1))
    narrow = running_sum(narrow.withColumn("_all", F.lit(0)), ["_all"], "pos", "start", "_before", "pos", bucket=F.col("part"))
    narrow = publish(narrow.select("pos", "open", (F.col("_before") + F.col("start")).alias("grp")))
    groups = publish(narrow.groupBy("grp").agg((F.min("pos") - 1).alias("a"), (F.max("pos") + 1).alias("b")))
    near = narrow.where("open").join(groups, "grp").select("pos", "a", "b")
    rows = kept.where("open").select("pos", "host", "path", "h0", "h1", "lines").join(near, "pos")
    for side in ("a", "b"):
        other = kept.select(F.col("pos").alias(side), "host", F.col("path").alias(f"{side}_path"), F.col("lines").alias(f"{side}_lines"))
        rows = rows.join(other, [side, "host"], "left")
    return rows.mapInArrow(_place, "host string, h0 long, h1 long, gone array<int>")


def deleted_lines(pages: DataFrame) -> DataFrame:
    """``(host, h0, h1, gone)``: numbers of the lines that go, for each html of a host that loses any, from ``(host, path, query, h0, h1, html)``."""

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_pack(page_lines(x.as_py())) for x in batch], pa.binary())

    lined = pages.where("host is not null").select("host", "path", "query", "h0", "h1", packed("html").alias("lines"))
    # equal html of a host is one page: the one of least path and query
    one = lined.groupBy("host", "h0", "h1").agg(F.min(F.struct("path", "query")).alias("at"), F.any_value("lines").alias("lines"))
    one = publish(one.select("host", "at.path", "at.query", "h0", "h1", "lines"))
    by = ("host", "path", "query", "h0", "h1")
    ranged = one.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        _ranges, "part int, no long, host string, path string, h0 long, h1 long, open boolean, follows boolean, gone array<int>, lines binary"
    )
    ranged = publish(ranged)
    names = ("host", "h0", "h1", "gone")
    return publish(ranged.where("not open").select(*names).unionByName(_place_open(ranged).select(*names)).where("size(gone) > 0"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", differencing: bool = True) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page (the contract of ``op2``); ``differencing=False`` leaves structure alone to decide."""
    bound_batches(pages)

    @F.arrow_udf("struct<text: string, lines: string>")
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """The text of a page without plain lines, which differencing can't change; the lines of others with their states."""
        for batch in batches:
            pages = [page_lines(x.as_py()) for x in batch]
            plain = [any(s == 0 for _, s in p) for p in pages]
            texts = [None if q else kept_text(p, []) for p, q in zip(pages, plain)]
            lines = ["\n".join(f"{s}{t}" for t, s in p) if q else None for p, q in zip(pages, plain)]
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(lines, pa.string())], ["text", "lines"])

    @F.arrow_udf("string")
    def joined(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lines, gone in batches:
            rows = zip(lines.to_pylist(), gone.to_pylist())
            yield pa.array([None if x is None else kept_text([(y[1:], int(y[0])) for y in x.split("\n")], g or []) for x, g in rows], pa.string())

    start = "^[a-zA-Z][a-zA-Z0-9+.-]*://"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumns({
        "host": F.nullif(F.lower(F.regexp_extract("url", f"{start}([^/?#]+)", 1)), F.lit("")),
        "path": F.regexp_extract("url", f"{start}[^/?#]+([^?#]*)", 1), "query": F.regexp_extract("url", rf"{start}[^/?#]+[^?#]*\?([^#]*)", 1),
        "h0": F.xxhash64(F.lit(0), "html"), "h1": F.xxhash64(F.lit(1), "html"),
    })
    out = rows.select("page_id", "url", "host", "h0", "h1", parsed("html").alias("p"))
    if differencing:  # read back with its size, so that Spark broadcasts it only if small
        out = out.join(deleted_lines(rows), ["host", "h0", "h1"], "left")
    else:
        out = out.withColumn("gone", F.lit(None).cast("array<int>"))
    out = out.select("page_id", "url", F.coalesce("p.text", joined("p.lines", "gone")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
