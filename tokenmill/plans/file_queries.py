"""Queries that write files in the supported formats and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.operators import corpus, logs, trainstats, vocab
from tokenmill.plans.analytics_queries import _lines
from tokenmill.plans.analytics_sql import CURVE, LINES
from tokenmill.plans.text_queries import SHARD, VOCAB_SIZE, _byte_stream
from tokenmill.plans.text_sql import BENCH, STREAM, with_
from tokenmill.scratch import new_path
from tokenmill.session import table
from tokenmill.sources import binfmt, readers

DOCS_PER_SHARD = 500


def _trimmed(text):
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def text_shard_files(spark, sf):
    """Documents in text shards with a marker between them; digests of the documents that are read back."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    folder = new_path(spark, "text-shards")
    readers.write_text_shards(d, corpus.text_shards(d, DOCS_PER_SHARD), folder)
    r = readers.text_shards(spark, f"{folder}/shard=*/*.txt")
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long")
    return r.groupBy(shard.alias("shard"), F.md5("document").alias("digest")).agg(F.count("*").alias("n"))


def story_files(spark, sf):
    """Conversations as JSON arrays of stories, fifty in a file."""
    c = table(spark, sf, "conversations").where("text is not null").select(F.floor(F.col("conv_id") / 50).alias("shard"), F.struct(F.col("text").alias("story")).alias("s"))
    folder = new_path(spark, "stories")
    c.groupBy("shard").agg(F.to_json(F.collect_list("s")).alias("value")).repartition("shard").write.partitionBy("shard").text(folder)
    r = readers.story_shards(spark, f"{folder}/shard=*/*.txt")
    return r.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


def example_files(spark, sf):
    """Benchmark items as JSON examples with endings."""
    b = table(spark, sf, "benchmark").where("text is not null")
    w = F.split("text", " ")
    rows = b.select(F.col("item_id").cast("int").alias("ind"), F.col("text").alias("ctx"), (F.col("item_id") % 4).cast("int").alias("label"), F.slice(w, 1, 4).alias("endings"), F.lit("val").alias("split"))
    path = new_path(spark, "examples")
    rows.write.json(path)
    r = readers.hellaswag(spark, path)
    return r.select("ind", "label", F.md5("ctx").alias("digest"), F.concat_ws("|", "endings").alias("endings"), F.col("activity_label").isNull().alias("no_label"))


def question_files(spark, sf):
    """Benchmark items as questions of headerless CSV files; texts with quotes, commas and line ends come back."""
    b = table(spark, sf, "benchmark").where("text is not null")
    letter = F.substring(F.lit("ABCD"), (F.col("item_id") % 4 + 1).cast("int"), F.lit(1))
    rows = b.select(F.concat(F.lit('"q", '), "text").alias("question"), *[F.lit(x).alias(x) for x in "abcd"], letter.alias("answer"))
    path = new_path(spark, "questions")
    rows.write.csv(path, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    r = readers.mmlu(spark, path)
    return r.groupBy(F.md5("question").alias("digest"), "answer", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


def token_shard_heads(spark, sf):
    """Headers of shard files, 16 and 32 bits wide."""
    found = None
    for wide in (False, True):
        folder = new_path(spark, "shards")
        binfmt.write_shards(_byte_stream(spark, sf), folder, 100_000 if wide else 257).count()
        heads = binfmt.peek_shards(spark, f"{folder}/*.bin").withColumn("wide", F.lit(wide))
        found = heads if found is None else found.union(heads)
    return found.select(F.regexp_extract("path", r"_(\d+)\.bin$", 1).cast("long").alias("shard"), "wide", "magic", "version", "n_tokens")


def vocab_file(spark, sf):
    """A vocabulary written as a file and read back."""
    uri = f"{new_path(spark, 'vocab')}/tokens.bin"
    binfmt.write_vocab(vocab.frequency_vocab(table(spark, sf, "benchmark"), VOCAB_SIZE), uri)
    return binfmt.read_vocab(spark, uri).select("token_id", F.hex("token").alias("token"), "kind")


def log_files(spark, sf):
    """Training logs as text files, a run for each 64th of the users; the curve of validation losses."""
    folder = new_path(spark, "logs")
    d = _lines(spark, sf, (F.col("user_id") % 64).cast("string"))
    d.repartition("run").sortWithinPartitions("run", "line_no").select("run", F.col("line").alias("value")).write.partitionBy("run").text(folder)
    rows = logs.read_log(spark, f"{folder}/run=*/*.txt").withColumn("run", F.regexp_extract("run", r"run=([^/]+)/", 1))
    return logs.val_curve(logs.parsed(rows)).select("run", "step", "val_loss")


def profile_files(spark, sf):
    """Orders as kernel rows of a profiler's CSV files with headings; passes and functions, those of the most time first."""
    o = table(spark, sf, "orders")
    kernels = ("encoder_forward(int)", "void layernorm_forward<float>(x)", "ampere_bf16_s16816gemm_128", "adamw_kernel3")
    name = F.element_at(F.array(*map(F.lit, kernels)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    number = {11: F.col("o_orderkey") % 7, 12: F.col("o_custkey") % 5, 13: F.floor("o_totalprice") + 1, 14: F.col("o_orderkey") % 11, 15: F.col("o_orderkey") % 13, 16: F.col("o_orderkey") % 100, 17: F.col("o_custkey") % 17}
    cells = [name if i == 4 else F.format_number(number[i].cast("long"), 0) if i in number else F.lit("x") for i in range(18)]
    heads = spark.range(2).select(*[F.lit(f"heading {i}").alias(f"c{i}") for i in range(18)])
    path = new_path(spark, "profile")
    heads.union(o.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])).write.csv(path)
    r = readers.profile(spark, path)
    return r.groupBy(F.col("kernel")).agg(F.count("*").alias("calls"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("read_gb", "write_gb", "time_ms", "l2_read", "l2_write", "tensor_pct", "instructions")])


def harness_files(spark, sf):
    """Results of tasks as JSON, written, read back and averaged."""
    e = table(spark, sf, "events").where("value is not null").groupBy("event_type").agg(F.round(F.avg("value") / 500, 9).alias("acc"))
    metrics = F.create_map(F.lit("acc_norm"), F.col("acc"), F.lit("other"), F.lit(0.5))
    path = new_path(spark, "harness")
    readers.write_json(e.select(F.create_map(F.concat(F.lit("task_"), "event_type"), metrics).alias("results")), path)
    return trainstats.harness_summary(readers.harness(spark, f"{path}/*.json", "acc_norm", lines=True)).withColumn("score", F.round("score", 5))


def metric_log_files(spark, sf):
    """Metric lines of every event written as a log, and its streams read back."""
    e = table(spark, sf, "events").where("value is not null").select(F.col("event_id").alias("step"), F.round("value", 2).alias("train_loss"), (F.col("event_id") % 9 / 1000).alias("lr"), F.lit(1.5).alias("norm"), F.when(F.col("event_id") % 10 == 0, F.round("value", 2)).alias("val_loss"))
    path = new_path(spark, "metrics")
    logs.append_metrics(e.where("step % 2 = 0"), path)
    logs.append_metrics(e.where("step % 2 = 1"), path)
    lines = spark.read.text(path).select(F.lit("main").alias("run"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return logs.stream_values(lines).select("stream", "step", F.round("value", 6).alias("value"))


def shard_list(spark, sf):
    """Files of a folder of shards in the order of their names, with their tokens and those before."""
    folder = new_path(spark, "shards")
    binfmt.write_shards(_byte_stream(spark, sf), folder, 257).count()
    r = binfmt.sorted_shards(spark, f"{folder}/*.bin")
    return r.select("ordinal", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "n_tokens", "before")


def queries() -> dict:
    found = (text_shard_files, story_files, example_files, question_files, token_shard_heads, vocab_file, log_files, profile_files, harness_files, metric_log_files, shard_list)
    return {f.__name__: f for f in found}


_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "text_shard_files": f"SELECT shard, md5({_TRIM}) AS digest, count(*) AS n FROM (SELECT text, ((row_number() OVER (ORDER BY doc_id) - 1) // {DOCS_PER_SHARD})::BIGINT AS shard FROM documents WHERE text IS NOT NULL) WHERE {_TRIM} != '' GROUP BY ALL",
        "story_files": "SELECT md5(trim(text)) AS digest, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1",
        "example_files": "SELECT item_id::INT AS ind, (item_id % 4)::INT AS label, md5(text) AS digest, array_to_string(string_split(text, ' ')[1:4], '|') AS endings, true AS no_label FROM benchmark WHERE text IS NOT NULL",
        "question_files": "SELECT md5('\"q\", ' || text) AS digest, substr('ABCD', (item_id % 4 + 1)::INT, 1) AS answer, (item_id % 4)::INT AS label, count(*) AS n FROM benchmark WHERE text IS NOT NULL GROUP BY ALL",
        "token_shard_heads": with_(*STREAM[:4]) + "SELECT shard, wide, CASE WHEN wide THEN 20240801 ELSE 20240520 END AS magic, CASE WHEN wide THEN 7 ELSE 1 END AS version, count(*) AS n_tokens FROM st, (SELECT unnest([false, true]) AS wide) GROUP BY ALL",
        "vocab_file": with_(*BENCH) + "SELECT * FROM v",
        "log_files": "WITH " + LINES.format(run="(user_id % 64)::VARCHAR") + CURVE + " SELECT run, step, val_loss FROM curve",
        "profile_files": """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'encoder_forward(int)' WHEN 1 THEN 'void layernorm_forward<float>(x)' WHEN 2 THEN 'ampere_bf16_s16816gemm_128' ELSE 'adamw_kernel3' END AS kernel, count(*) AS calls,
sum(o_orderkey % 7)::BIGINT AS read_gb, sum(o_custkey % 5)::BIGINT AS write_gb, sum(floor(o_totalprice) + 1)::BIGINT AS time_ms, sum(o_orderkey % 11)::BIGINT AS l2_read, sum(o_orderkey % 13)::BIGINT AS l2_write, sum(o_orderkey % 100)::BIGINT AS tensor_pct, sum(o_custkey % 17)::BIGINT AS instructions FROM orders GROUP BY 1""",
        "harness_files": "WITH t AS (SELECT 'task_' || event_type AS task, round(avg(value) / 500, 9) * 100 AS score FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT task, round(score, 5) AS score FROM t UNION ALL SELECT 'average', round(avg(score), 5) FROM t",
        "metric_log_files": "SELECT stream, step, round(value, 6) AS value FROM (SELECT event_id AS step, unnest([{'stream': 'trl', 'value': round(value, 2)}, {'stream': 'lr', 'value': event_id % 9 / 1000}, {'stream': 'norm', 'value': 1.5}], recursive := true) FROM events WHERE value IS NOT NULL UNION ALL SELECT event_id, 'tel', round(value, 2) FROM events WHERE value IS NOT NULL AND event_id % 10 = 0)",
        "shard_list": with_(*STREAM[:4], "n AS (SELECT shard, count(*) AS n_tokens FROM st GROUP BY shard)") + "SELECT row_number() OVER (ORDER BY file) - 1 AS ordinal, file, n_tokens, (sum(n_tokens) OVER (ORDER BY file) - n_tokens)::BIGINT AS before FROM (SELECT printf('tokens_%s_%06d.bin', CASE WHEN shard = 0 THEN 'val' ELSE 'train' END, shard) AS file, n_tokens FROM n)",
    }
