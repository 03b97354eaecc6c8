"""Phrases, repair of conversations and language-model scores against brute force, on hand-made rows with the awkward cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from letterspark.llm import language_model, phrases, repair, text_blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
rng = random.Random(7)


def prose(n: int) -> str:
    return "".join(rng.choice("a A b c the of été straße x_y q".split()) + rng.choice([" "] * 8 + [", ", ". ", "\n", "\t ", "  ", "\r\n", ":", " \x0b"]) for _ in range(n))


LONG = prose(9000)
ROWS = [(i, prose(n), lang, "s", 1) for i, (n, lang) in enumerate(product((0, 1, 2, 5, 40, 200, 90, 11), ("en", "de", None)))]
ROWS += [(100, None, "en", "s", None), (101, "", None, None, 0), (102, " \t\n", "fr", "s", 3), (103, LONG, "en", "s", 1), (104, "é" * 70, "en", "s", 70), (None, ROWS[9][1], "en", None, 2), ROWS[12], ROWS[12], (105, ",,;", None, "s", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(params=[2 << 20, 300])
def block_bytes(request, monkeypatch):
    monkeypatch.setattr(text_blocks, "BLOCK_BYTES", request.param)


def counted(rows, least):
    """All phrases by a dictionary."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            w = [x for x in re.split(rb"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", b" ".join(w[i : i + k]).decode()) for k in range(1, 5) for i in range(len(w) - k + 1))
    return {k: c for k, c in f.items() if c >= least}, n


@pytest.mark.parametrize("bits", [64, 7])
def test_phrases_equal_brute_force(spark, docs, block_bytes, bits):
    """Also with fingerprints so short that most of them collide."""
    found, sizes = phrases.frequent_phrases(docs, least=4, bits=bits)
    want, n = counted(ROWS, 4)
    assert {(r.lang, r.phrase): r.a for r in found.collect()} == want
    assert {r.lang: r.n for r in sizes.collect()} == dict(n)


def test_collocations_equal_brute_force(spark, docs, block_bytes):
    want, n = counted(ROWS, 30)
    score = {}
    for (lang, p), a in want.items():
        w = p.split(" ")
        cuts = [(2000000 * a // (want[lang, " ".join(w[:k])] + want[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        if cuts:
            s, k = min(cuts)
            score[lang, p] = a, want[lang, " ".join(w[:k])], want[lang, " ".join(w[k:])], s
    kept = [(lang, p) for lang, p in score if not any(q != p and l2 == lang and f" {p} " in f" {q} " and 100 * want[l2, q] >= 80 * want[lang, p] for l2, q in score)]
    ranked = defaultdict(list)
    for lang, p in kept:
        ranked[lang].append((-score[lang, p][3], -score[lang, p][0], p.encode(), p))
    rows = {(lang, k + 1, x[3], *score[lang, x[3]][:3], n[lang], score[lang, x[3]][3]) for lang, each in ranked.items() for k, x in enumerate(sorted(each)[:2000])}
    got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs).collect()}
    assert got == rows and len(rows) > 20
    top = {(r.lang, r["rank"], r.phrase) for r in phrases.collocations(docs, top=3).collect()}
    assert top == {x[:3] for x in rows if x[1] <= 3}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 1 << 62
    rows = [("x", "a", 1, big), ("x", "b", 1, big + 1), ("x", "c", 1, big), ("x", "a b", 2, big), ("x", "b c", 2, big), ("x", "a b c", 3, big - 1)]
    df = spark.createDataFrame(rows, "lang string, phrase string, words int, a long")
    got = {r.phrase: (r.l, r.r, r.score) for r in phrases.scored_phrases(df).collect()}
    assert got == {"a b": (big, big + 1, 2000000 * big // (2 * big + 1)), "b c": (big + 1, big, 2000000 * big // (2 * big + 1)), "a b c": (big, big, 2000000 * (big - 1) // (2 * big))}
    assert [r.phrase for r in phrases.uncontained(phrases.scored_phrases(df), df).collect()] == ["a b c"]


@pytest.mark.parametrize("step", [phrases.collocations, language_model.language_model_scores])
def test_extra_columns_and_empty_tables(spark, docs, step):
    names = ["block", "data", "ends", "part", "answer", "short", "_train", "_a1", "held_out", "n", "a"]
    wide = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    assert sorted(map(str, step(wide).collect())) == sorted(map(str, step(docs).collect()))
    assert step(docs.limit(0)).count() == 0


def tokens(text):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().translate(LOWER)) if w] + ["end"]


def grams(ts, k):
    line = ["start"] * (k - 1) + ts
    return [tuple(line[i : i + k]) for i in range(len(ts))]


def test_language_model_equals_brute_force(spark, docs, block_bytes):
    """Counts, base and interpolated scores from dictionaries; EM on the ratios themselves, not on their cells."""
    rest = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10
    c, h = ({k: Counter() for k in (0, 1, 2, 3)} for _ in range(2))
    for i, text, *_ in ROWS:
        if rest(i):
            for to in (c, h) if rest(i) == 1 else (c,):
                to[0]["docs"] += 1
                for k in (1, 2, 3):
                    to[k].update(grams(tokens(text), k))
    n, v = sum(c[1].values()), len(c[1])
    assert sum(h[1].values()) > 20

    def estimates(ts, less):
        each = {k: grams(ts, k) for k in (1, 2, 3)}
        for at in range(len(ts)):
            out = []
            for k in (1, 2, 3):
                g = each[k][at]
                if k == 1:
                    past = n - less * sum(h[1].values())
                elif at == 0:
                    past = c[0]["docs"] - less * h[0]["docs"]
                else:
                    past = c[k - 1][each[k - 1][at - 1]] - less * h[k - 1][each[k - 1][at - 1]]
                out.append(((c[k][g] - less * h[k][g]) / past if past else 0.0, past.bit_length()))
            yield out

    weights = []

    def p_of(each, upto):
        p = 1 / (v + 1)
        for w, (ml, b) in zip(weights[:upto], each):
            m = w.get(b, w[min(w, key=lambda x: (x > b, abs(x - b)))]) if b else 0.0
            p = m * ml + (1 - m) * p
        return p

    tuning = [e for i, text, *_ in ROWS if rest(i) == 1 for e in estimates(tokens(text), 1)]
    for k in range(3):
        ratios = defaultdict(list)
        for each in tuning:
            if each[k][1]:
                ratios[each[k][1]].append(each[k][0] / p_of(each, k))
        w = {}
        for b, r in ratios.items():
            m = 0.5
            for _ in range(language_model.ROUNDS):
                m = min(language_model.MOST, sum(m * x / (m * x + 1 - m) for x in r) / len(r))
            w[b] = m
        weights.append(w)
    got = sorted(language_model.language_model_scores(docs).collect(), key=str)
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, text, *_ in ROWS:
        ts, r = tokens(text), by[i][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(i) == 0, len(ts), sum(c[1][t,] > 0 for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((c[1][t,] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p_of(e, 3)) for e in estimates(ts, 0)), rel_tol=0.02, abs_tol=0.05)


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = language_model.language_model_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_learned_weights_rise_with_the_evidence():
    one = language_model.learn([(3, 8 * 64 + 1 + 24, 90, 270.0), (3, 0, 10, 0.0), (5, 8 * 64 + 1 + 24, 50, 150.0), (5, 0, 50, 0.0)])
    assert one[0] == 0 and one[3] > one[5] > 0 and one[4] == one[3] and one[1] == one[2] == one[3] and one[64] == one[5]
    assert np.all(language_model.learn([])[1:] == 0.5)


def cheapest(turns):
    """Dynamic programming over the states of the role pattern."""
    def inserted(best):
        for _ in range(3):
            for s, (cost, edits) in list(best.items()):
                t = repair.next_state(s)
                best[t] = min(best.get(t, (10**9, "")), (cost + 3, edits + "I"))
        return best

    best = {repair.NONE: (0, "")}
    for initial, cut in turns:
        new = {}
        for s, (cost, edits) in inserted(dict(best)).items():
            kept = repair._KEEP.get((initial, s))
            moves = [("D", 4, s)] + ([("K", cut, kept)] if kept is not None else []) + ([("R", 3 + cut, repair.next_state(s))] if initial else [])
            for e, more, t in moves:
                new[t] = min(new.get(t, (10**9, "")), (cost + more, edits + e))
        best = new
    best = inserted(best)
    return min(best[s] for s in repair.FINAL if s in best)


def test_search_equals_dynamic_programming():
    for n in [*range(14), 30, 60] * 12:
        turns = [(rng.choice(["", "s", "u", "a", "u", "a", "x"]), rng.choice([0, 0, 3])) for _ in range(n)]
        assert repair.search(turns) == cheapest(turns)
        size = rng.randint(1, 9)
        blocks = [repair.choices(turns[k : k + size]) for k in range(0, n, size)]
        if blocks:
            pairs = repair.chain(blocks)
            edits = "".join(next(c["audit"] for c in b if (c["start"], c["end"]) == p) for b, p in zip(blocks, pairs))
            assert edits + repair._TAIL[pairs[-1][1]][0] == cheapest(turns)[1]


@pytest.mark.parametrize("block", [512, 3])
def test_repair_equals_brute_force(spark, block, monkeypatch):
    """Nulls, ties, repeated rows, a very long conversation, odd roles, a conversation of which nothing is left, extra columns."""
    monkeypatch.setattr(repair, "BLOCK", block)
    texts = ["Yes.", "no", "Why?", "so \t", "\x0b\x0c", None, "", "end! \r\n", "é.", "x" * 3000]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "usher", "tool"]
    rows = [(c, t, rng.choice(roles[: 4 if c % 2 else 9]), rng.choice(texts[: 4 if c % 3 else 10])) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(77, rng.choice([k, None]), rng.choice(roles), rng.choice(texts)) for k in range(900)]
    rows += [(None, 1, "user", "a."), (None, None, None, None), (78, 1, "user", "b."), *[(79, 5, "user", "same.")] * 40]
    gone = next(c for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "hello"))
    want, groups = {}, defaultdict(list)
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if key == 4 else role, "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
        groups[c] += [(t is not None, t or 0, role, text)] * (0 if key == 0 else 2 if key == 3 else 1)
    for c, each in groups.items():
        each.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        seen, codes, faults = set(), [], Counter()
        for _, _, role, text in each:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            codes.append(("" if fault in ("blank", "duplicate") else role[:1] or "?", 3 * (fault == "truncated")))
        cost, audit = cheapest(codes)
        turns = [t for ok, t, *_ in each if ok]
        lines = "\n".join(f"{t['role']}:{t['text']}" for t in repair.apply_edits([x[2:] for x in each], audit, repair.NONE)[0])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(each, each[1:]))
        want[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = repair.repaired_conversations(df.withColumns({"conv": F.lit(1), "block": F.lit(2), "n": F.lit(3), "key": F.lit(4)})).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert want[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repaired_conversations(df.limit(0)).count() == 0
