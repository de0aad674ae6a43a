"""Readers of text corpora, example sets and profiles, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.operators.corpus import MARKER, split_documents

HELLASWAG = "ind int, activity_label string, ctx_a string, ctx_b string, ctx string, split string, split_type string, label int, endings array<string>, source_id string"
MMLU = "question string, a string, b string, c string, d string, answer string"
WEB = "text string, id string, dump string, url string, date string, file_path string, language string, language_score double, token_count int"
#: Columns of a kernel profile, by their place.
PROFILE = {4: "kernel", 11: "read_gb", 12: "write_gb", 13: "time_ms", 14: "l2_read", 15: "l2_write", 16: "tensor_pct", 17: "instructions"}


def text_shards(spark: SparkSession, glob: str, marker: str = MARKER) -> DataFrame:
    """``path, part, document``: documents of text files that a marker separates."""
    d = spark.read.text(glob, lineSep=marker).select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("line"))
    return split_documents(d).select("path", "line", "document")


def write_text_shards(docs: DataFrame, shards: DataFrame, folder: str, marker: str = MARKER) -> None:
    """One folder of text for each shard; documents in the order of their ids, a marker between them."""
    d = docs.join(shards, "doc_id").repartition("shard").sortWithinPartitions("shard", "doc_id")
    d.select("shard", F.col("text").alias("value")).write.mode("ignore").partitionBy("shard").option("lineSep", f"\n{marker}\n").text(folder)


def story_shards(spark: SparkSession, glob: str) -> DataFrame:
    """``path, text`` of JSON arrays of objects with a ``story``, trimmed."""
    d = spark.read.schema("story string").json(glob, multiLine=True)
    return d.select(F.input_file_name().alias("path"), F.trim("story").alias("text"))


def hellaswag(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HELLASWAG).json(path)


def mmlu(spark: SparkSession, glob: str) -> DataFrame:
    """Questions of headerless CSV files, with the answer's place as ``label``. Quotes in a field are doubled; a quoted field may have line ends."""
    return spark.read.schema(MMLU).csv(glob, escape='"', multiLine=True).withColumn("label", F.instr(F.lit("ABCD"), F.col("answer")) - 1)


def profile(spark: SparkSession, path: str) -> DataFrame:
    """Kernel rows of a profiler's CSV files: those with a number in each column of numbers. Heading rows have none, in whichever file and part they stand."""
    schema = ", ".join(f"c{i} string" for i in range(max(PROFILE) + 1))
    d = spark.read.schema(schema).csv(path)
    numbers = {n: F.expr(f"try_cast(replace(c{i}, ',', '') AS double)") for i, n in PROFILE.items() if n != "kernel"}
    return d.select(*[x.alias(n) for n, x in numbers.items()], F.col("c4").alias("kernel")).dropna(subset=list(numbers))


def harness(spark: SparkSession, glob: str, metric: str, lines: bool = False) -> DataFrame:
    """``task, value`` of harness results: a JSON object of tasks under ``results``, each with its metrics; ``lines``: files have such an object on each line."""
    d = spark.read.schema("results map<string, map<string, double>>").json(glob, multiLine=not lines)
    return d.select(F.explode("results").alias("task", "m")).select("task", F.element_at("m", metric).alias("value")).where("value is not null")


def write_json(results: DataFrame, folder: str) -> None:
    """Results as JSON objects, one a line; a folder that is there stays as it is."""
    results.write.mode("ignore").json(folder)
