"""Corpus access: byte budgets, document and section splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.bytesx import to_bytes
from tokenmill.operators.prefix import running_sum

MARKER = "<|endoftext|>"


def corpus_prefix(docs: DataFrame, max_bytes: int, text: str = "text") -> DataFrame:
    """``doc_id, before, data``: documents in the order of their ids up to a budget of bytes; the one that straddles it is cut. Repeated ids keep a row each, null ids come last."""
    d = docs.where(F.col(text).isNotNull()).select("doc_id", to_bytes(text).alias("data")).withColumn("size", F.octet_length("data").cast("long"))
    return running_sum(d, "doc_id", "size").where(F.col("before") < max_bytes).select("doc_id", "before", F.substring("data", F.lit(1), F.least(F.col("size"), max_bytes - F.col("before")).cast("int")).alias("data"))


def character_prefix(docs: DataFrame, max_chars: int) -> DataFrame:
    """``doc_id, before, text``: the same up to a budget of characters."""
    d = docs.where("text is not null").select("doc_id", "text").withColumn("size", F.length("text").cast("long"))
    return running_sum(d, "doc_id", "size").where(F.col("before") < max_chars).select("doc_id", "before", F.substring("text", F.lit(1), F.least(F.col("size"), max_chars - F.col("before")).cast("int")).alias("text"))


def split_documents(df: DataFrame, text: str = "text", marker: str = MARKER) -> DataFrame:
    """One row for each part between markers, trimmed, blank ones dropped; ``part`` counts from 0 as they stand."""
    parts = F.split(F.col(text), "\\Q" + marker + "\\E", -1)
    d = df.select("*", F.posexplode(parts).alias("part", "__raw"))
    return d.withColumn("document", F.regexp_replace("__raw", r"^[\s]+|[\s]+$", "")).where(F.length("document") > 0).drop("__raw")


def split_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each section between blank lines; all but the last keep their blank line."""
    parts = F.split(F.col(text), "\n\n", -1)
    d = df.select("*", F.size(parts).alias("__n"), F.posexplode(parts).alias("section_no", "__raw"))
    return d.withColumn("section", F.when(F.col("section_no") < F.col("__n") - 1, F.concat("__raw", F.lit("\n\n"))).otherwise(F.col("__raw"))).drop("__raw", "__n")


def text_shards(docs: DataFrame, per_shard: int) -> DataFrame:
    """``doc_id, shard``: a fixed number of documents in each shard, in the order of their ids."""
    return running_sum(docs.select("doc_id", F.lit(1).alias("one")), "doc_id", "one", "ordinal").select("doc_id", F.floor(F.col("ordinal") / per_shard).alias("shard"))


def shuffled(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` in a seeded pseudo-random order that depends on their ids alone."""
    return docs.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id")
