"""One record a message, from parsed header blocks or from a table of fields that were parsed before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterspark.functions.text import redact, split_message
from letterspark.operators import headers as E

#: Header evidence that later rules read, kept in the record's ``facts``.
FACTS = {
    "spf": "string", "dkim": "string", "dmarc": "string", "auth_aligned": "boolean", "authenticated_domain": "string", "org_domain": "string", "recipient_domain": "string", "freemail": "boolean",
    "name_has_address": "boolean", "reply_to_divergence": "boolean", "reply_domain": "string", "envelope_mismatch": "boolean", "from_matches_org": "boolean",
}
#: Fields of a record that stand in a header, with their types.
FIELDS = {
    "message_id": "string", "in_reply_to": "string", "references": "array<string>", "from_addr": "string", "from_name": "string", "from_domain": "string", "subject": "string", "sent_at": "timestamp",
    "origin_ip": "string", "mailer": "string", "received_hops": "int", "list_mail": "boolean",
}
MOST_REFERENCES = 100


def references(value: Column, most: int = MOST_REFERENCES) -> Column:
    """Ids of a table cell, a list in JSON or a string with spaces between; NULL and what can't be read give none."""
    bare = F.trim(value)
    listed = F.coalesce(F.from_json(bare, "array<string>"), F.array().cast("array<string>"))
    split = F.filter(F.split(F.coalesce(bare, F.lit("")), r"\s+"), lambda x: x != "")
    return F.slice(F.filter(F.when(F.startswith(bare, F.lit("[")), listed).otherwise(split), lambda x: x.isNotNull()), 1, most)


def _record(df: DataFrame, key: str, source: str, body: str) -> DataFrame:
    """The shape of a record: absent columns are NULL, but a subject is never NULL, nor are the texts and ``list_mail``."""
    absent = {c: F.lit(None).cast(kind) for c, kind in (FIELDS | FACTS).items() if c not in df.columns}
    rows = df.withColumns(absent) if absent else df
    rows = rows.withColumn("_p", split_message(F.coalesce(body, F.lit(""))))
    own = {c: F.col(c).cast(kind) for c, kind in FIELDS.items()}
    own |= {"subject": F.coalesce("subject", F.lit("")), "list_mail": F.coalesce("list_mail", F.lit(False)), "references": F.slice(F.coalesce("references", F.array().cast("array<string>")), 1, MOST_REFERENCES)}
    facts = F.struct(*(F.col(c).cast(kind).alias(c) for c, kind in FACTS.items()))
    return rows.select(
        F.col(key).alias("key"), F.col(source).alias("source"), *(v.alias(c) for c, v in own.items()), F.col("_p.text").alias("text"), F.col("_p.quoted").alias("quoted"), F.col("_p.full").alias("full"),
        redact(F.col("_p.text")).alias("redacted"), facts.alias("facts"),
    )


def from_blocks(df: DataFrame, key: str = "id", source: str = "source", headers: str = "raw_headers", body: str = "body") -> DataFrame:
    """Records of header blocks and bodies that haven't been parsed yet; two projections, no join."""
    df = df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(headers).alias("_headers"), F.col(body).alias("_body"))
    found = E.evidence(df, "_key", "_headers", "_headers", "_source", "_body").drop("from_name", "send_hour", "auth_source")
    parsed = E.fields(found, "_key", "_headers", *(c for c in found.columns if c not in ("_key", "_headers")))
    return _record(parsed.withColumn("from_domain", F.col("from_registered")), "_key", "_source", "_body")


def from_table(df: DataFrame, key: str = "id", source: str = "source", body: str = "body") -> DataFrame:
    """Records of rows whose header was parsed before, each with its raw body; ``references`` may be a list or text, ``from_registered`` is the sender's domain."""
    if "from_registered" in df.columns:
        df = df.withColumn("from_domain", F.col("from_registered"))
    if dict(df.dtypes).get("references") == "string":
        df = df.withColumn("references", references(F.col("references")))
    return _record(df, key, source, body)


def union_records(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """Both kinds of records in one table; a key that stands in both is taken from the table, where it was parsed once."""
    return table.unionByName(blocks.join(table.select("key"), "key", "left_anti"))
