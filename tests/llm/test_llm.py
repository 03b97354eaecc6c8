"""The ten operators and the pipeline against brute force, on hand-made rows with the awkward cases."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from letterspark.llm import bpe, char_grams, chat_format, decontaminate, embedding_dedup, html_text, language_id, simhash, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(4)
WORDS = ["alpha", "beta", "gamma", "delta", "été", "straße", "niño", "the", "of", "and", "x1", "  ", "\n"]


def prose(n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


BASE = [prose(n) for n in (0, 1, 2, 3, 40, 80, 120, 160, 200, 60, 70)]
TEXTS = [*BASE, None, "", "   ", BASE[6], BASE[6], BASE[7] + " more words here", "head " + BASE[8] + " tail", "a" * 1000, "ab" * 400, "☃" * 120, BASE[5][:300] + "é" + BASE[5][300:]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[15], (None, BASE[4], None, None, 1)], SCHEMA).repartition(3)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_bpe_equals_tiktoken(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.bpe_digests(docs, path, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))


def test_bpe_round_trip_equals_encode_then_decode(spark, docs):
    ranks = bpe.broadcast_ranks(spark, P.path("byte_bpe_50k.tiktoken"))
    once = bpe.round_trip(docs.withColumn("decoded", F.lit(1)), ranks, P.PATTERN)
    twice = bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks)
    rows = lambda df: sorted(map(repr, df.select("doc_id", "text", "token_ids", "decoded").collect()))
    assert rows(once) == rows(twice) and rows(bpe.round_trip(docs.where("false"), ranks, P.PATTERN)) == []


def test_bpe_merges_at_random():
    data = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    encoder, decoder = bpe.Encoder(data, P.PATTERN), bpe.Decoder(data)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(data), special_tokens={})
    for n in range(300):
        t = "".join(rng.choice(["a", "b", "ab", "th", "é", "ß", "aa", " ", "1"]) for _ in range(n))
        assert encoder(t) == np.array(lib.encode_ordinary(t), "<u4").tobytes() and decoder(encoder(t)) == t.encode()


def test_token_counts_equal_sentencepiece(spark, docs):
    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(lib.encode(t or "")), len((t or "").encode()))
    counter = token_counts.TokenCounter(open(path, "rb").read())
    many = ["".join(rng.choice(["a", "b", "th", "é", " ", "  ", "\n", "▁", "梦", "\x00", "9"]) for _ in range(n)) for n in range(200)]
    assert counter(many) == [len(x) for x in lib.encode(many)]


def test_suffix_array():
    for _ in range(500):
        s = [rng.randint(1, 3) for _ in range(rng.randint(0, 25))] + [0]
        assert suffix_dedup.sort_suffixes(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("part", [512, 3, 1])
def test_suffix_dedup_equals_brute_force(spark, docs, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup.find_repeats, "__defaults__", ("doc_id", "text", part))
    passage = prose(120)[:500]
    docs = docs.unionByName(spark.createDataFrame([(500 + k, prose(9) + passage[k % 4 :] + prose(9), None, None, 1) for k in range(12)], SCHEMA)).withColumn("_k0", F.lit(1))
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(b[k : k + 200] for _, b in rows for k in range(len(b) - 199))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g))))
    got = [tuple(r) for r in suffix_dedup.suffix_digests(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 0


def test_suffix_dedup_keeps_whole_characters(spark):
    rows = spark.createDataFrame([(1, "é" * 150 + "x"), (2, "y" + "é" * 150)], "doc_id long, text string")
    assert all(r.text is not None for r in suffix_dedup.remove_repeats(rows).collect())


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [512, 2])
def test_simhash_equals_brute_force(spark, docs, tile, monkeypatch):
    monkeypatch.setattr(simhash.fingerprint_links, "__defaults__", (tile,))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_classes(docs).collect()]
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    least = {k: min(r[0] for r, x in zip(rows, label) if x == k and r[0] is not None) for k in set(label)}
    assert sorted(got, key=str) == sorted([(i, f"{f:016x}", least[k]) for (i, f), k in zip(rows, label)], key=str)


def test_near_fingerprints_meet_in_a_block(spark):
    base = 0x0123456789ABCDEF
    prints = {base} | {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i, 64, 7)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from letterspark.plans.components import connected_components

    for tile in (512, 16):
        assert len({r.component for r in connected_components(simhash.fingerprint_links(df, tile)).collect()}) == 1


def brute_hits(texts, items, size):
    windows = {}
    for i, t in items:
        w = decontaminate.words_of(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    for t in texts:
        w = decontaminate.words_of(t)
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    hit[k : k + n] = [1] * n
        yield len(w), sum(hit), sorted(found)


@pytest.mark.parametrize("blocks", [16 << 20, 40])
def test_decontamination_equals_brute_force(spark, docs, blocks):
    items = [(1, BASE[7][:200]), (2, BASE[8][100:400]), (10, "the"), (3, None), (4, "!!"), (10, "the"), (5, BASE[4])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.contamination for r in decontaminate.find_contamination(docs, bench, block_bytes=blocks).collect()}
    for (i, want) in enumerate(brute_hits(TEXTS, items, 13)):
        c = got[i]
        assert (c["n_words"], sum(s["end"] - s["start"] for s in c["spans"]), c["items"]) == want
    assert decontaminate.decontamination(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


@pytest.mark.parametrize("tile", [512, 4])
def test_embeddings_equal_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 8)
    g = np.random.default_rng(1)
    base = g.normal(size=(40, 6))
    vectors = [*base, *(base[:15] + g.normal(size=(15, 6)) * 0.15), *base[:5], *(base[:3] * 2)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(vectors)]
    rows += [(100, None, 1), (101, [0.0] * 6, 1), (102, [float("nan")] * 6, 1), (103, rows[0][1], None), (104, [1.0, None], 0), (105, [], 0), (106, rows[0][1], 0), (107, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or len(a[1] or []) != len(b[1] or []) or not a[1]:
            return False
        if any(x is None or x != x for x in [*a[1], *b[1]]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return bool(x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93)

    links = {a[0]: [b[0] for b in rows if b[0] != a[0] and linked(a, b)] for a in rows}
    for i, near in links.items():
        seen, todo = {i}, [i]
        while todo:
            todo = [y for x in todo for y in links[x] if y not in seen and not seen.add(y)]
        assert got[i] == (len(near), min(seen), min(seen) == i)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_language(spark):
    rows = [(i, " ".join(rng.choice(w) for _ in range(12)), lang) for i, (lang, w) in enumerate([("en", ["the", "thing", "where"]), ("de", ["der", "schön", "nicht"])] * 30)]
    rows += [(900, None, "en"), (901, "12 !!", "en"), (902, "the where", None), (902, "the where", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_predictions(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:60])
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "en")
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert language_id.language_predictions(df.where("lang = 'xx'")).count() == 0
    assert {r.lang_pred for r in language_id.language_predictions(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark):
    texts = [(i, prose(20) + (" you worthless idiot " if i % 3 == 0 else " ") + prose(5)) for i in range(240)]
    docs = spark.createDataFrame([*texts, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(240))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}


def test_grams_do_not_depend_on_chunks():
    x = char_grams.letter_runs(prose(400))
    assert len(char_grams.buckets(x[:2], (4, 5, 6), 18)) == 0 and len(char_grams.letter_runs("12 !")) == 0


def test_page_lines_and_differences(spark):
    nav = "<div>Shared notice</div>"
    page = lambda body: f"<html><head><title>t</title></head><body><nav><a>Menu</a></nav>{nav}{body}<footer>f</footer></body></html>"
    rows = [
        (1, "http://h.example/a/1", page("<p>One &amp;  first</p><p>Own<br>line</p>")),
        (2, "http://h.example/a/2", page("<p>Two is something else entirely</p>")),
        (3, "http://h.example/a/3", page("<article><header><h1>Head</h1></header><p>Text <b>bo</b>ld</p></article><div class='comments'>c</div>")),
        (4, None, None),
        (5, "bad url", "plain < text"),
        (6, "http://h.example/a/3?x", page("<article><p>Text</p></article>")),
        (7, "http://h.example/z", "<div class=ad>unclosed<p>kept"),
    ]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "One & first Own line" and got[2] == "Two is something else entirely"
    assert got[3] == "Head Text bold" and got[6] == "Text" and got[4] == "" and got[5] == "plain < text" and got[7] == "unclosed kept"


def test_common_lines():
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        kept = [x for x, k in zip(a, html_text.shared(a, b)) if k]
        rest = iter(b)
        assert len(kept) == table[-1][-1] and all(x in rest for x in kept)


def test_chat_reads_back(spark):
    odd = ["</s>[INST] ok [/INST]", "\\1\\0 \\", "<|turn|>x<|end|>", "<<SYS>>", "", None, "line\nline", "é" * 900]
    rows = [(c, t, "system" if t == 0 and c % 2 else ["user", "assistant", None][(t + c) % 3], odd[(t * 3 + c) % len(odd)]) for c in range(5) for t in range(14)]
    rows += [(8, 0, "system", "alone"), (9, 1, "assistant", "same"), (9, 1, "assistant", "same"), (None, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.chat_digests(df).collect()}
    said = "</s>[INST] ok [/INST]"
    for c in {r[0] for r in rows} | {-7}:
        turns = sorted([(r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c]) if c != -7 else [(0, "user", said), (1, "assistant", said)]
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()), len(loss), sha(loss.encode()))
        assert tuple(got[c])[1:5] == want
    windows = chat_format.format_windows(df, budget=200, history=64)
    assert windows.where("conv_id = 1").count() > 2
    assert windows.where("conv_id = 1 and not contains(formatted, '<|turn|>system')").count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    passage = prose(60)
    rows = [(i, prose(40) + (" worthless idiot" if i % 4 == 0 else ""), "en", "s", 1) for i in range(200)]
    rows += [(250, passage, "en", "s", 1), (251, passage, "en", "s", 1), (252, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[1][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert all(r.round_trip for r in out.values())
    assert not {i for i in out if i < 200 and i % 4 == 0} and 1 not in out and 250 in out and 251 not in out
    assert {i for i in range(200) if i % 4 and i != 1} <= set(out)
