"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from letterspark.llm import chat_format, phrases, repair
from letterspark.llm.bpe import bpe_digests
from letterspark.llm.common import table
from letterspark.llm.decontaminate import decontamination
from letterspark.llm.embedding_dedup import near_duplicates
from letterspark.llm.html_text import extract_text
from letterspark.llm.language_id import language_predictions
from letterspark.llm.language_model import language_model_scores
from letterspark.llm.repair import repaired_conversations
from letterspark.llm.simhash import simhash_classes
from letterspark.llm.suffix_dedup import suffix_digests
from letterspark.llm.token_counts import token_counts
from letterspark.llm.toxicity import toxicity_scores


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_digests(table(spark, sf_dir, "conversations"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digests(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_html_text,
        op3_chat_format,
        op4_language_id,
        op5_embedding_dedup,
        op6_toxicity,
        op7_token_counts,
        op8_suffix_dedup,
        op9_simhash,
        op10_decontamination,
        op11_phrases,
        op12_repair,
        op13_language_model,
    )
}

#: DuckDB SQL with the same rows.
ORACLE_SQL: dict[str, str] = {
    "op11_phrases": phrases.SQL,
    "op12_repair": repair.SQL,
    "op3_chat_format": chat_format.SQL,
    "op5_embedding_dedup": """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
ok as (select * from v where vec_id is not null and label is not null and len(e) > 0
  and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
pairs as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id, vec_id as other from ok union select r.vec_id, p.b from reach r join pairs p on p.a = r.other),
comp as (select vec_id, min(other) as c from reach group by 1),
links as (select a, count(*) as n from pairs group by 1)
select v.vec_id, coalesce(l.n, 0)::bigint as n_links, coalesce(c.c, v.vec_id) as component_id, v.vec_id = coalesce(c.c, v.vec_id) as kept
from v left join comp c on v.vec_id = c.vec_id left join links l on v.vec_id = l.a
""",
    "op10_decontamination": r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from iw where len(w) > 0)),
sizes as (select distinct n from win),
dwin as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw cross join sizes where len(w) >= n)),
hit as (select d.doc_id, d.i, d.n, win.item_id from dwin d join win on d.n = win.n and d.s = win.s),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item_id::varchar as item from hit where item_id is not null) group by 1)
select dw.doc_id, len(dw.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(dw.w) as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
""",
}
