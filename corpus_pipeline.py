"""A training-data pipeline over the documents table, one operator for each stage.

Every stage gets all rows that the stage before it kept, as a Parquet table, and returns the
columns of documents; the last one returns the mix. Null and empty texts and rows without a
doc_id pass the first four stages; repeated rows of a doc_id and text leave one row. Empty tables
give empty stages, and columns of any name and type pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.automaton import decontaminate
from tokenmill.llm.mixing import mix
from tokenmill.llm.queries import label_weights
from tokenmill.llm.simhash import keep_firsts
from tokenmill.llm.suffix_dedup import remove_repeats
from tokenmill.llm.toxicity import reject_toxic
from tokenmill.scratch import stage
from tokenmill.session import table


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """With n_chars as it is after a change of the text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*like.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents of a toxicity score of 0.5 or more."""
    return reject_toxic(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal or of a verified five-word similarity of 0.8, keep one, that of the smallest doc_id."""
    return keep_firsts(docs).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut bytes that a 100-byte string covers which starts earlier; texts of nothing else go."""
    return _counted(remove_repeats(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut spans that benchmark items contain; documents that mostly consist of them go."""
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights (see op1_mix)."""
    return mix(docs, label_weights(table(spark, sf_dir, "labels")))


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("suffix dedup", suffix_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: SQL can express neither the compression distances of the first stage nor the fingerprints of the second.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table; every stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs, _ = stage(f(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
