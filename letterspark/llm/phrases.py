"""Phrase collocation mining: Rabin-Karp fingerprints of n-grams, counted by shuffle, verified against the text.

Prefix polynomials in numpy give the fingerprint of every n-gram of a block of texts
(``text_blocks``). A shuffle of packed arrays sums each fingerprint over all blocks; the
pointer of an occurrence is its block and slot, and the reply says which slots reach the
least count. Words and pairs go first. Of longer n-grams only those go whose pairs are all
frequent, as no other can be frequent. Each block then compares all occurrences of a
frequent slot byte by byte with the first, so that n-grams of equal fingerprints part, and
writes out the text of frequent n-grams only, once with its count; counts by text are
exact, since a collision only makes a sum too large. Scores and containment work on the
frequent phrases, as joins.

Defined results: a null text is empty; a null language is ``und``. Phrases don't cross
pieces or documents. Repeated rows count as often as they occur. Equal scores go by the
number of occurrences, then by the bytes of the phrase. An empty table has no phrases.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterspark.llm.common import publish
from letterspark.llm.text_blocks import Words, exchange, flags_of, gram_hashes, mix, take_spans, text_blocks, with_answers

LONGEST = 4
LEAST = 30
SCALE = 2_000_000
#: A phrase goes if a longer one that holds it has this share of its occurrences, in hundredths.
CONTAINED = 80
TOP = 2000
UNKNOWN = "und"
#: Kinds of bytes (fixed values): blanks part words, these marks and line ends part pieces.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Grams:
    """The n-grams of a block: ``prints[n - 1]`` at every word, ``whole[n - 1]`` where n words stand in one piece."""

    def __init__(self, row: dict, longest: int, bits: int = 64):
        ends = np.frombuffer(row["ends"], np.int64)
        self.words = Words(row["data"], ends, _KINDS)
        index = {lang: k for k, lang in enumerate(dict.fromkeys(row["lang"]))}
        self.langs = list(index)
        seed = np.array([int.from_bytes(lang.encode()[-8:], "little") ^ len(lang.encode()) for lang in self.langs], np.uint64)
        self.lang = np.array([index[x] for x in row["lang"]])[self.words.doc]
        own = mix(seed)[self.lang] if len(self.words) else np.empty(0, np.uint64)
        piece, n = self.words.piece, len(self.words)
        self.whole = [np.flatnonzero(piece[k:] == piece[: n - k]) if k < n else np.empty(0, np.int64) for k in range(longest)]
        rest = np.uint64(64 - bits)
        self.prints = [mix(gram_hashes(self.words.hash, k + 1)[at] ^ own[at]) >> rest << rest for k, at in enumerate(self.whole)]

    def frequent(self, kept: list[np.ndarray], k: int) -> np.ndarray:
        """Which n-grams of ``k + 1`` words have only frequent parts of ``len(kept)`` words, given as places."""
        n = len(kept) - 1
        ok = np.zeros(len(self.words) + 1, bool)
        ok[kept[n]] = True
        at = self.whole[k]
        return reduce(np.logical_and, (ok[at + j] for j in range(k - n + 1))) if len(at) else np.empty(0, bool)


def _distinct(*prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(prints), return_counts=True)


def _kept(grams: Grams, row: dict) -> list[np.ndarray]:
    """Places of the frequent words and pairs."""
    slots, _ = _distinct(*grams.prints[:2])
    flags = flags_of(row["short"])
    return [at[flags[np.searchsorted(slots, p)]] for at, p in zip(grams.whole[:2], grams.prints)]


def _longer(grams: Grams, row: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places and prints of the longer n-grams whose pairs are all frequent."""
    kept = _kept(grams, row)
    some = [grams.frequent(kept, k) for k in range(2, len(grams.whole))]
    return [at[s] for at, s in zip(grams.whole[2:], some)], [p[s] for p, s in zip(grams.prints[2:], some)]


def _texts(grams: Grams, n: int, at: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, words, n) of the n-grams at ``at``: one for each distinct text."""
    words = grams.words
    slots, first, slot, count = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    start, size = words.at[at], words.at[at + n] - 1 - words.at[at]
    like = first[slot]
    other = (size != size[like]) | (grams.lang[at] != grams.lang[at[like]])
    same = np.flatnonzero(~other)
    differ = take_spans(words.text, start[same], size[same]) != take_spans(words.text, start[like[same]], size[same])
    if differ.any():
        other[same[np.unique(np.searchsorted(np.add.accumulate(size[same]), np.flatnonzero(differ), "right"))]] = True
    count = count - np.bincount(slot[other], minlength=len(slots))
    odd: dict[tuple[int, bytes], int] = {}
    for k in np.flatnonzero(other):  # fingerprints that collide in this block
        key = int(grams.lang[at[k]]), words.text[start[k] : start[k] + size[k]].tobytes()
        odd[key] = odd.get(key, 0) + 1
    offsets = np.r_[0, np.add.accumulate(size[first])].astype(np.int32)
    phrases = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(take_spans(words.text, start[first], size[first])))
    names = pa.DictionaryArray.from_arrays(pa.array(grams.lang[at[first]].astype(np.int32)), pa.array(grams.langs, pa.string())).dictionary_decode()
    yield pa.RecordBatch.from_arrays([names, phrases, pa.array(np.full(len(first), n, np.int32)), pa.array(count.astype(np.int64))], ["lang", "phrase", "words", "n"])
    if odd:
        yield pa.RecordBatch.from_pylist([{"lang": grams.langs[g], "phrase": t.decode(), "words": n, "n": c} for (g, t), c in odd.items()], schema=pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())]))


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Rows ``(lang, phrase, words, a)`` of all phrases of 1 to ``longest`` words that occur ``least`` times, and ``(lang, n)``: the words of each language.

    ``bits`` of a fingerprint are used; fewer mean more texts to compare, not other counts.
    """
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    blocks = publish(text_blocks(rows, "text", ["lang"]))

    def enough(sums: np.ndarray) -> np.ndarray:
        return sums[0] >= least

    def longer_slots(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return _distinct(*_longer(Grams(row, longest, bits), row)[1])

    def materialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, longest, bits)
                sizes = np.bincount(grams.lang, minlength=len(grams.langs))
                yield pa.RecordBatch.from_arrays([pa.array(grams.langs, pa.string()), pa.array([None] * len(sizes), pa.string()), pa.array(np.zeros(len(sizes), np.int32)), pa.array(sizes.astype(np.int64))], ["lang", "phrase", "words", "n"])
                for k, at in enumerate(_kept(grams, row)):
                    if len(at):
                        yield from _texts(grams, k + 1, at, grams.prints[k][np.searchsorted(grams.whole[k], at)])
                places, prints = _longer(grams, row)
                slots, _ = _distinct(*prints) if prints else (np.empty(0, np.uint64), None)
                flags = flags_of(row["long"])
                for k, (at, p) in enumerate(zip(places, prints)):
                    ok = flags[np.searchsorted(slots, p)]
                    if ok.any():
                        yield from _texts(grams, k + 3, at[ok], p[ok])

    short = publish(exchange(blocks, lambda row: _distinct(*Grams(row, 2, bits).prints), enough))
    long = publish(exchange(with_answers(blocks, short=short), longer_slots, enough)) if longest > 2 else short.where("false")
    found = with_answers(blocks, short=short, long=long).mapInArrow(materialise, "lang string, phrase string, words int, n long")
    counts = publish(found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).where(f"words = 0 or a >= {int(least)}"))
    return counts.where("words > 0"), counts.where("words = 0").select("lang", F.col("a").alias("n"))


def scored_phrases(phrases: DataFrame) -> DataFrame:
    """Rows ``(lang, phrase, a, l, r, score)`` of the phrases of two words or more: the cut of least score, of those the first.

    Both sides of a cut occur as often as the phrase at least, so the joins find them among the frequent.
    """
    cuts = phrases.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = F.split("phrase", " ")
    cuts = cuts.withColumn("first", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    for name, side in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    score = F.expr(f"cast({SCALE} as decimal(7, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)")
    best = F.min(F.struct(F.col("score"), F.col("k"), F.col("l"), F.col("r")))
    return cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(best.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def uncontained(scored: DataFrame, phrases: DataFrame) -> DataFrame:
    """Without the phrases that a longer one holds with ``CONTAINED`` hundredths of their occurrences or more."""
    parts = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda k: F.array_join(F.slice(parts, k, n), " "))))
    inside = phrases.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("_most")).groupBy("lang", "phrase").agg(F.max("_most").alias("_most"))
    decimal = lambda c: F.col(c).cast("decimal(20, 0)")
    kept = F.col("_most").isNull() | (F.lit(100) * decimal("_most") < F.lit(CONTAINED) * decimal("a"))
    return scored.join(inside, ["lang", "phrase"], "left").where(kept).drop("_most")


def collocations(documents: DataFrame, top: int = TOP) -> DataFrame:
    """The first phrases of each language (the contract of ``op11``)."""
    phrases, sizes = frequent_phrases(documents)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = uncontained(scored_phrases(phrases), phrases).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
sizes as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words cross join range(1, 5) as ks(k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) as a from grams group by all having count(*) >= 30),
cuts as (select lang, k, phrase, a, unnest(range(1, k)) as c, string_split(phrase, ' ') as w from f where k > 1),
scores as (select u.lang, u.phrase, u.a, u.c, x.a as l, y.a as r, ((2000000::hugeint * u.a) // (x.a + y.a))::bigint as score
  from cuts u join f x on x.lang = u.lang and x.phrase = array_to_string(u.w[1 : u.c], ' ') join f y on y.lang = u.lang and y.phrase = array_to_string(u.w[u.c + 1 :], ' ')),
cut as (select * from scores qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(a) as most
  from (select lang, w, a, m, unnest(range(1, k - m + 2)) as i from (select lang, k, a, string_split(phrase, ' ') as w, unnest(range(2, k)) as m from f where k > 2)) group by all)
select c.lang, row_number() over (partition by c.lang order by score desc, a desc, c.phrase) as rank, c.phrase, a, l, r, n, score
from cut c join sizes using (lang) left join inside i on i.lang = c.lang and i.phrase = c.phrase
where most is null or 100::hugeint * most < 80::hugeint * a
qualify rank <= 2000
"""
