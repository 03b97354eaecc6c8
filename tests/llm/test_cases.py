"""Awkward tables for every operator and stage: clashing names, empty tables, nulls, very long texts, ties; brute force for the two models."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from letterspark.llm import bpe, char_grams, chat_format, decontaminate, embedding_dedup, html_text, language_id, queries, simhash, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)


def prose(n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(30) + (" you worthless idiot" if i % 5 == 0 else ""), "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows += [(100, None, None, None, None), (None, None, None, None, None), (101, "", "en", "s", 0), (None, rows[0][1], None, None, 2), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark, docs):
    return spark.createDataFrame([(1, prose(30)), (2, None), (None, "x y")], "item_id long, text string")


def stages(spark, labels, bench):
    ranks = bpe.broadcast_ranks(spark, P.path("byte_bpe_50k.tiktoken"))
    model = token_counts.broadcast_model(spark, P.path("piece_bpe_32k.model"))
    return {
        "bpe": lambda d: bpe.round_trip(d, ranks, P.PATTERN),
        "counts": lambda d: token_counts.count_tokens(d, model),
        "language": lambda d: language_id.predict(d, language_id.train(d)),
        "toxicity": lambda d: toxicity.drop_toxic(d, labels),
        "suffix": suffix_dedup.remove_repeats,
        "simhash": simhash.keep_one,
        "contamination": lambda d: decontaminate.drop_contaminated(d, bench),
        "spans": lambda d: decontaminate.find_contamination(d, bench, block_bytes=20),
    }


CLASH = ["_k0", "_k1", "_both", "_score", "_found", "_block", "_blocks", "_cut", "_r0", "_r1", "_r2", "H", "pack", "fp", "class", "component", "packs", "_K0"]


@pytest.mark.parametrize("name", ["bpe", "counts", "language", "toxicity", "suffix", "simhash", "contamination", "spans"])
def test_clashing_columns_and_empty_tables(spark, docs, labels, bench, name):
    stage = stages(spark, labels, bench)[name]
    extra = [c for c in CLASH if c != "_K0"]
    wide = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(extra)))
    out = stage(wide)
    assert set(wide.columns) <= set(out.columns)
    kept = out.select(*extra).distinct().collect()
    assert [tuple(r) for r in kept] == [tuple(range(len(extra)))]
    plain = stage(docs)
    assert sorted(map(str, out.select(docs.columns).collect())) == sorted(map(str, plain.select(docs.columns).collect()))
    assert stage(docs.limit(0)).count() == 0


def test_empty_tables_of_the_queries(spark, tmp_path):
    empty = {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string",
             "conversations": "conv_id long, turn long, role string, text string", "embeddings": "vec_id long, embedding array<float>, label int"}
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, f in queries.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == (1 if name.startswith("op3") else 0)  # op3 adds a conversation
    import corpus_pipeline

    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts(spark, labels, bench, monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK", 64)
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    long = " ".join(prose(9) for _ in range(20000))
    again = long[1000:400_000]
    df = spark.createDataFrame([(1, long, "en", "s", 1), (2, again + "é", "de", "s", 1), (3, "short", "en", "s", 1)], SCHEMA)
    got = {r.doc_id: r for r in suffix_dedup.suffix_digests(df).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (len(again), len(again), 0)
    for stage in stages(spark, labels, bench).values():
        assert {r.doc_id for r in stage(df).select("doc_id").collect()} == {1, 2, 3}


def test_grams_of_parts_are_those_of_the_whole():
    for n in (1, 2, 3, 5, 200):
        x = char_grams.letter_runs(prose(n))
        for orders, size in (((1, 2, 3), 7), ((4, 5, 6), 16), ((1, 2, 3), 1)):
            whole = Counter(char_grams.buckets(x, orders, 15).tolist())
            assert sum((Counter(p.tolist()) for p in char_grams.bucket_parts(x, orders, 15, size)), Counter()) == whole


@pytest.mark.parametrize("block", [128, 2])
def test_language_equals_brute_force(spark, docs, block, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rows = [(i, prose(12), rng.choice(["aa", "bb", "cc", "dd", "ee"])) for i in range(80)] + [(200, None, "aa"), (201, "12 !", "bb"), (202, "abc", None), (203, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, texts = defaultdict(Counter), Counter()
    grams = lambda t: [int(b) for n in (1, 2, 3) for k in range(len(x) - n + 1) for b in char_grams.buckets(x[k : k + n], (n,), 15)] if len(x := char_grams.letter_runs(t or "")) else []
    for i, t, lang in rows:
        if lang and grams(t) and zlib.crc32(str(i).encode()) % 5:
            counts[lang].update(grams(t))
            texts[lang] += 1
    got = {r.doc_id: r for r in language_id.language_predictions(df).collect()}
    for i, t, _ in rows:
        if not grams(t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        s = {}
        for lang in counts:
            total = sum(counts[lang].values()) + 0.5 * 2**15
            s[lang] = math.log(texts[lang] / sum(texts.values())) + sum(math.log((counts[lang][g] + 0.5) / total) for g in grams(t))
        best = max(s.values())
        assert got[i].lang_pred == max(sorted(s), key=s.get) and abs(got[i].score - 1 / sum(math.exp(v - best) for v in s.values())) < 1e-3


def test_equal_languages_go_by_name(spark):
    df = spark.createDataFrame([(i, "same text", lang) for i in range(40) for lang in ("b", "a")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, round(r.score, 6)) for r in language_id.language_predictions(df).collect()} == {("a", 0.5)}


def test_toxicity_equals_brute_force(spark, docs, labels):
    """The log-count ratios and the score of every text, from sets of n-grams."""
    model = toxicity.train(docs, labels, 1000)
    weights, b = model
    got = toxicity.score(docs.select("doc_id", "text"), model).collect()
    grams = lambda t: {int(g) for n in (4, 5, 6) for k in range(len(x) - n + 1) for g in char_grams.buckets(x[k : k + n], (n,), 18)} if len(x := char_grams.letter_runs(t or "")) else set()
    for r in got:
        z = sum(weights[g] for g in grams(r.text)) + b
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6
    assert np.count_nonzero(weights) <= toxicity.FEATURES


def test_equal_urls_are_ordered_by_content(spark):
    rows = [(k, "http://h.example/a", f"<p>{'x' * k} own</p><p>shared</p>") for k in range(4)] + [(9, "http://h.example/a", None), (10, "http://h.example/a", "")]
    a, b = ({r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)).collect()} for n in (1, 3))
    assert a == b and a[9] == a[10] == ""


def test_chat_and_vectors_with_extra_columns(spark):
    chat = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    wide = chat.withColumns({"block": F.lit(1), "pos": F.lit(2), "starts": F.lit(3)})
    assert sorted(map(str, chat_format.chat_digests(wide).collect())) == sorted(map(str, chat_format.chat_digests(chat).collect()))
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    w = v.withColumns({"cid": F.lit(1), "w": F.lit(2), "p": F.lit(3)})
    assert sorted(map(str, embedding_dedup.near_duplicates(w).collect())) == sorted(map(str, embedding_dedup.near_duplicates(v).collect()))
