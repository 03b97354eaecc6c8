"""Rows that the operators must neither lose nor treat differently, on hand-made tables."""

from __future__ import annotations

import random

import pytest

from letterspark.llm import html_text, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)


def words(n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_one_row_of_each_class_stays(spark):
    a, b, c, d, e = (words(60) for _ in range(5))
    rows = [(1, a), (1, a), (2, b), (2, c), (3, c), (None, d), (None, d), (None, e), (5, a), (None, b)]
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], SCHEMA).repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (2, c), (None, d), (None, e)], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_pipeline_keeps_the_text_of_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    a, b = words(60), words(60)
    rows = [(i, words(40) + (" worthless idiot" if i % 4 == 0 else "")) for i in range(80)]
    rows += [(250, a), (250, a), (None, b), (None, b)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words(30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert [n > 60 for i, n in out if i == 250] == [True] and [n > 60 for i, n in out if i is None] == [True]


def brute_common(a: list[str], b: list[str]) -> list[bool]:
    """Lines of ``a`` in a longest common subsequence, by the full table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    keep, i, j = [False] * len(a), len(a), len(b)
    while i and j:
        if t[i][j] == t[i][j - 1]:
            j -= 1
        elif t[i][j] == t[i - 1][j]:
            i -= 1
        else:
            keep[i - 1] = True
            i, j = i - 1, j - 1
    return keep


def brute_compare(x: list[tuple[str, int]], y: list[tuple[str, int]]) -> tuple[list[bool], bool]:
    found = brute_common([t for t, _ in x], [t for t, _ in y])
    judged = 2 if any(s == 2 for _, s in x) else 0
    both = sum(len(t) for (t, s), f in zip(x, found) if f and s == judged)
    return found, both > 0.6 * sum(len(t) for t, s in x if s == judged)


def brute_texts(rows: list[tuple]) -> dict[int, str]:
    """Texts of pages of one host: each page's nearest URL before and after is sought among all pages of the host."""
    least = {}
    for _, path, html in sorted(rows, key=lambda r: r[1]):
        least.setdefault(html, path)
    order = [(p, h, html_text.page_lines(h)) for h, p in sorted(least.items(), key=lambda x: x[1])]
    alike = lambda i, k: any(brute_compare(x, y)[1] for x, y in ((order[i][2], order[k][2]), (order[k][2], order[i][2])))
    linked = [i > 0 and alike(i, i - 1) for i in range(len(order))]
    text = {}
    for i, (path, html, lines) in enumerate(order):
        a, b = i, i + 1
        while linked[a]:
            a -= 1
        while b < len(order) and linked[b]:
            b += 1
        near = [k for k in (a - 1, b) if 0 <= k < len(order)]
        near.sort(key=lambda k: -next((n for n, (x, y) in enumerate(zip(path, order[k][0])) if x != y), min(len(path), len(order[k][0]))))
        gone = [False] * len(lines)
        for k in near:
            if not brute_compare(lines, order[k][2])[1]:
                plain = [n for n, (_, s) in enumerate(lines) if s == 0]
                for n, f in zip(plain, brute_common([lines[n][0] for n in plain], [t for t, _ in order[k][2]])):
                    gone[n] = f
                break
        text[html] = " ".join(t for (t, s), g in zip(lines, gone) if s == 2 or s == 0 and not g)
    return {i: text[h] for i, _, h in rows}


@pytest.mark.parametrize("n", [10, 130, 1000])
def test_sections_of_a_host_of_any_size(spark, n):
    """Pages in sections, each with a line that its pages share and one that the host shares."""
    rows = [(i, f"/s{i % max(2, n // 20):02}/{i:04}", f"<div>All of the host</div><p>{words(8)}</p><p>Of section {i % max(2, n // 20)}</p><p>own {i}</p>") for i in range(n)]
    rows += [(5000, "/s00/x", f"<div>All of the host</div><article><p>Of section 0</p><p>{words(5)}</p></article><p>Of section 0</p>")]
    pages = spark.createDataFrame([(i, f"https://h.example{p}", h) for i, p, h in rows], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got == brute_texts(rows) and not any("section" in t for i, t in got.items() if i < 5000)
    assert got[5000].startswith("Of section 0 ") and got[5000].count("section") == 1
    assert {r.page_id: r.text for r in html_text.extract_text(pages, differencing=False).collect()} != got


def test_article_text_stays_under_names_like_boilerplate():
    text = lambda html: html_text.kept_text(html_text.page_lines(html), [])
    assert text('<article><p class="share-price">Up</p><div id="banner-year">1999</div></article>') == "Up 1999"
    assert text('<main><div class="search-results">One</div><p class="notice">Two</p></main>') == "One Two"
    assert text('<div class="post-comments-open"><article><p>Whole</p></article></div>') == "Whole"
    assert text('<form class="search"><article><p>Whole</p></article></form><div class="ad">Buy</div>') == "Whole"
    assert text('<article><p>A</p><div class="ad big">Buy</div><nav>N</nav><section id="comments">Hm</section></article><div class="sidebar">S</div>') == "A"


def test_long_alignments_take_halves(monkeypatch):
    monkeypatch.setattr(html_text, "ALIGNED", 64)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 60))] for _ in range(2))
        assert sum(html_text.shared(a, b)) == sum(brute_common(a, b))
        kept, rest = [x for x, k in zip(a, html_text.shared(a, b)) if k], iter(b)
        assert all(x in rest for x in kept)


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
def test_siblings_and_copies_of_a_large_host(spark, ranges):
    rows = []
    for i in range(300):
        body = f"<p>{words(12)}</p><p>shared by pair {i // 2}</p><p>{words(3)}</p>"
        if 100 <= i < 140:
            body = f"<p>{'the copied page ' * 9}</p><p>own {i}</p><p>shared by pair 49</p>" if i % 3 else rows[-1][2]
        rows.append((i, f"/en/{i:04}", body))
    rows += [(900 + k, f"/zz/{k}", rows[10][2]) for k in range(5)]
    want = brute_texts(rows)
    pages = [(i, f"http://Big.example{p}", h) for i, p, h in rows] + [(2000 + i, f"http://h{i}.example/", "<p>alone</p>") for i in range(20)] + [(3000, None, None)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(pages) and {i: got[i] for i, _, _ in rows} == want
    assert not any("pair" in got[i] for i in range(1, 90, 2)) and len({got[900 + k] for k in range(5)} | {got[10]}) == 1
    assert got[3000] == "" and all(got[2000 + i] == "alone" for i in range(20))
