"""The corpus pipeline: toxicity, near-duplicates, repeated strings, contamination, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes every
result as Parquet in the shared folder and reads it back as the next stage's documents.
All stages but the last return the columns of ``documents``; the last returns doc_id,
lang, source, the packed token ids, their number and whether they decode to the text.

Every stage takes empty tables and keeps extra columns of its documents, whatever their names,
up to the last, which returns its own columns only. A null text counts as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterspark.llm.bpe import broadcast_ranks, round_trip
from letterspark.llm.common import publish, table
from letterspark.llm.decontaminate import drop_contaminated
from letterspark.llm.simhash import keep_one
from letterspark.llm.suffix_dedup import remove_repeats
from letterspark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Empty texts are scored like others. Repeated rows have equal scores, so they stay or go together; without labels none goes.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays, of least id.

    Documents without words are a class of their own. Of rows that repeat that id one stays.
    """
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start at two places or more are cut out; ``n_chars`` follows.

    No row goes: a text that is cut out whole is empty, and all places of a string are cut alike. Shorter texts stay as they are.
    """
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: those with a twentieth of their words inside passages of the benchmark.

    Documents without words stay, as do all where the benchmark is empty. Repeated rows share a fate.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to its bytes.

    A row each row, also of repeated ids; an empty text has no tokens and decodes.
    """
    ranks = broadcast_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = round_trip(docs, ranks, public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        "lang",
        "source",
        "token_ids",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the classifier nor the merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = publish(stage(spark, docs, sf_dir))
    return docs
