"""Queries over training logs, metric streams, choices and numeric primitives.

The events table serves as the log of several runs: a run for each user, a line for each event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions import devices as devs
from tokenmill.functions import numeric, schedules
from tokenmill.functions.bytesx import byte_array, to_bytes
from tokenmill.operators import choice, logs, pack, trainstats
from tokenmill.operators.corpus import corpus_prefix
from tokenmill.session import table

TOTAL_BATCH = 16_384
TARGET = 20.0
PEAK, WARMUP, STEPS, FINAL = 6e-4, 70, 1_000, 0.1


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _lines(spark, sf, run: Column | None = None) -> DataFrame:
    """Clicks and views are train lines, others val lines."""
    e = _events(spark, sf)
    train = F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit("/99999 | train loss "), F.format_string("%.2f", "value"), F.lit(" | norm 1.0"))
    line = F.when(F.col("event_id") % 3 != 0, train).otherwise(F.concat(F.lit("val loss "), F.format_string("%.2f", "value")))
    return e.select((run if run is not None else F.col("user_id").cast("string")).alias("run"), F.col("event_id").alias("line_no"), line.alias("line"))


def log_val_curve(spark, sf):
    return logs.val_curve(logs.parsed(_lines(spark, sf)))


def log_final_val(spark, sf):
    return logs.final_val(logs.val_curve(logs.parsed(_lines(spark, sf))))


def log_records(spark, sf):
    return logs.records(logs.parsed(_lines(spark, sf)))


def log_steps_once(spark, sf):
    return logs.steps_once(_lines(spark, sf))


def log_target(spark, sf):
    r = logs.records(logs.parsed(_lines(spark, sf)))
    return logs.reached(r, r.select("run").distinct().withColumn("target", F.lit(TARGET)))


def _arms(spark, sf):
    """Two runs, with their measured bytes for each token."""
    arm = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    r = logs.records(logs.parsed(_lines(spark, sf, arm)))
    density = spark.createDataFrame([("even", 3.6), ("odd", 2.5)], "run string, bytes_per_token double")
    return r, F.broadcast(density)


def convergence(spark, sf):
    r, density = _arms(spark, sf)
    t = density.select("run", F.lit(1.0).alias("target"))
    p = logs.consumption(logs.reached(r, t).join(density, "run"), TOTAL_BATCH)
    h = logs.head_to_head(p, "even", "odd")
    return h.select(*[F.round(c, 6).alias(c) for c in ("base_bytes", "base_bpb", "other_bytes", "other_bpb", "ratio", "saving_pct")], "winner")


def equal_compute(spark, sf):
    r, density = _arms(spark, sf)
    n = logs.nearest(r, logs.equal_step(r)).join(density, "run")
    return logs.consumption(n, TOTAL_BATCH).select("run", "at", "step", "val_loss", F.round("bpb", 6).alias("bpb"))


def metric_streams(spark, sf):
    """Metric lines whose steps rewind: the last value of each step counts."""
    e = _events(spark, sf)
    line = F.concat(F.lit("s:"), (F.col("event_id") % 50).cast("string"), F.lit(" trl:"), F.format_string("%.3f", "value"), F.lit(" norm:"), F.format_string("%.3f", F.col("value") / 7))
    return logs.stream_values(e.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("line_no"), line.alias("line")))


def stream_ranges(spark, sf):
    return logs.stream_ranges(metric_streams(spark, sf))


def last_values(spark, sf):
    """Latest value of each user and event type."""
    return _events(spark, sf).groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


def _z(spark, sf):
    e = _events(spark, sf).select("event_id", "event_type", "value")
    return trainstats.zscores(e, ["event_type"], "event_id", "value")


def zscore_outliers(spark, sf):
    return _z(spark, sf).select("event_id", "event_type", F.round("z", 6).alias("z"))


def skip_updates(spark, sf):
    z = _z(spark, sf)
    return z.groupBy("event_type").agg(F.sum(trainstats.skip_update(F.col("z"), F.lit(None).cast("double"), 2.0, 0.0).cast("long")).alias("skipped"), F.count("z").alias("scored"))


def moving_average(spark, sf):
    e = _events(spark, sf).select("event_id", "event_type", "value")
    return trainstats.moving_average(e, ["event_type"], "event_id", "value", 5).select("event_id", F.round("smooth", 6).alias("smooth"))


def ema_rate(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "value")
    return trainstats.ema(e, ["user_id"], "event_id", "value").select("event_id", F.round("ema", 4).alias("ema"))


def lr_schedules(spark, sf):
    s = _events(spark, sf).select((F.col("event_id") % (STEPS + 1)).alias("step")).distinct()
    d = s.withColumn("name", F.explode(F.array(*map(F.lit, schedules.NAMES))))
    return d.select("name", "step", F.round(schedules.by_name(F.col("name"), F.col("step"), PEAK, WARMUP, STEPS, FINAL), 10).alias("lr"))


def bytes_per_token_source(spark, sf):
    e = _events(spark, sf).select("event_id", F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("override"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 2).alias("measured"))
    return e.select("event_id", logs.bytes_per_token("override", "measured", 3.6).alias("bytes_per_token"))


def percent_gate(spark, sf):
    e = _events(spark, sf)
    found = e.select(F.col("event_id").alias("idx"), "value")
    golden = e.where("event_id % 10 != 9").select(F.col("event_id").alias("idx"), F.round("value", 0).alias("value"))
    return logs.percent_gate(found, golden, 1.0).select("idx", "found", "golden", F.round("diff_pct", 6).alias("diff_pct"), "ok")


def fixed_columns(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("line_no"), F.concat(F.lpad(F.col("event_id").cast("string"), 8, " "), F.lpad(F.format_string("%.4f", "value"), 12, " "), F.col("event_type")).alias("line"))
    first = e.groupBy("run").agg(F.min("line_no").alias("m"))
    r = logs.fixed_columns(e, "click", 9, 12, 400)
    return r.join(first, "run").select("run", "idx", "value")


def done_markers(spark, sf):
    p = _events(spark, sf).select(F.concat(F.lit("out/"), F.when(F.col("event_id") % 2 == 0, "DONE_").otherwise("model_"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("path"))
    return logs.highest_done(p)


def checkpoint_retention(spark, sf):
    e = _events(spark, sf).select("event_id")
    now = e.agg(F.max("event_id")).first()[0]
    return e.select("event_id", trainstats.keep_checkpoint(F.col("event_id"), F.lit(now), 3, 50, 200).alias("kept"))


def harness_rollup(spark, sf):
    h = _events(spark, sf).select(F.col("event_type").alias("task"), (F.col("value") / 500).alias("value"))
    return trainstats.harness_summary(h).withColumn("score", F.round("score", 6))


def kernel_rollup(spark, sf):
    """Orders as kernel calls: priority is the pass, status the kernel."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("phase"), F.col("o_orderstatus").alias("kernel"), (F.col("o_totalprice") / 1000).alias("time_ms"), (F.col("o_orderkey") % 7).cast("double").alias("read_gb"), (F.col("o_custkey") % 5).cast("double").alias("write_gb"), (F.col("o_orderkey") % 100).cast("double").alias("tensor_pct"))
    k = trainstats.kernel_summary(o)
    return k.select("phase", "kernel", "calls", *[F.round(c, 2).alias(c) for c in ("time_ms", "read_gb", "write_gb", "tensor_pct", "max_bandwidth", "share")])


def recent_mean(spark, sf):
    return trainstats.mean_of_last(_events(spark, sf), "event_id", "value").withColumn("mean_last", F.round("mean_last", 6))


def val_batches(spark, sf):
    return trainstats.mean_of_batches(_events(spark, sf), "user_id", "event_id", "value", 10).withColumn("mean_loss", F.round("mean_loss", 6))


def auto_config(spark, sf):
    e = _events(spark, sf).select("event_id", "value")
    return e.select("event_id", trainstats.ladder(F.col("value"), [(70.0, "large"), (35.0, "medium"), (14.0, "small")], "tiny").alias("config"))


def accumulation(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 8 + 1) * 524_288).alias("total_batch"))
    return s.select("s_suppkey", pack.accumulation_steps(F.col("total_batch"), 4, 1_024, 8).alias("micro_batches"), F.floor(F.lit(10_000_000_000) / F.col("total_batch")).alias("epoch_steps"))


def utilisation(spark, sf):
    """Of every device in each precision that it has."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("precision"), F.col(p).alias("base")) for p in devs.PRECISIONS]))
    d = devs.devices(spark).select("*", each.alias("r")).where("r.base is not null")
    peak = numeric.promised_tflops(F.col("r.base"), F.col("cores"), F.col("base_cores"), F.col("clock"), F.col("base_clock"))
    use = numeric.utilisation(F.lit(124_475_904.0), F.lit(12.0), F.lit(768.0), F.lit(1024.0), F.lit(524_288.0), F.lit(3.0), F.col("peak"))
    return d.withColumn("peak", peak).select("device", "r.precision", F.round("peak", 2).alias("peak"), F.round(use, 6).alias("mfu"))


def _examples(spark, sf):
    """Benchmark items as examples: five words of context and four endings of three words."""
    b = table(spark, sf, "benchmark").where("text is not null")
    w = F.split("text", " ")
    join = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    ends = F.array(*[byte_array(to_bytes(F.concat(F.lit(" "), join(6 + 3 * k, 3 + k % 2)))) for k in range(4)])
    return b.select(F.col("item_id").alias("example_id"), (F.col("item_id") % 4).cast("int").alias("label"), byte_array(to_bytes(join(1, 5))).alias("context"), ends.alias("endings"))


def choice_render(spark, sf):
    r = choice.render(_examples(spark, sf))
    return r.select("example_id", "label", "choice", "context_len", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"), F.array_join(F.transform("mask", lambda x: x.cast("string")), "").alias("mask"))


def _predictions(spark, sf):
    r = choice.render(_examples(spark, sf))
    loss = F.transform("targets", lambda x, i: ((x * 31 + i * 17 + F.col("choice") * 7) % 97).cast("double") / 64)
    return choice.predictions(choice.choice_losses(r.withColumn("losses", loss)))


def choice_predictions(spark, sf):
    return _predictions(spark, sf)


def choice_accuracy(spark, sf):
    return choice.accuracy(_predictions(spark, sf)).select("n", F.round("acc", 6).alias("acc"), F.round("acc_norm", 6).alias("acc_norm"))


def running_accuracy(spark, sf):
    p = _predictions(spark, sf).withColumn("bench", F.lit("items"))
    return choice.running_accuracy(p, ["bench"], "example_id").select("example_id", "n_seen", F.round("acc", 6).alias("acc"))


def label_accuracy(spark, sf):
    """Quality labels against a rule on the text's length."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("pred"))
    j = table(spark, sf, "labels").join(d, "doc_id")
    return j.groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("quality")).cast("int")), 6).alias("acc"))


def eval_stream(spark, sf):
    s = choice.eval_stream(_examples(spark, sf))
    return s.select("example_id", F.size("ints").cast("long").alias("n_ints"), "n_bytes", F.aggregate("ints", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").where("embedding is not null")


def softmax_loss(spark, sf):
    v = _vectors(spark, sf)
    return v.select("vec_id", F.round(numeric.cross_entropy(F.col("embedding"), F.col("label")), 6).alias("loss"))


def softmax_rows(spark, sf):
    v = _vectors(spark, sf).select("vec_id", F.posexplode(numeric.softmax(F.col("embedding"))).alias("i", "p"))
    return v.select("vec_id", "i", F.round("p", 8).alias("p"))


def gelu_values(spark, sf):
    v = _vectors(spark, sf).select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return v.select("vec_id", F.round(numeric.gelu(F.col("x") * 8), 8).alias("y"))


def standardised(spark, sf):
    v = _vectors(spark, sf).select("vec_id", numeric.standardise(F.col("embedding")).alias("z"))
    return v.select("vec_id", F.round(F.get("z", F.lit(0)), 6).alias("z0"), F.round(F.array_max("z"), 6).alias("z_max"))


def global_norm(spark, sf):
    return numeric.global_norm(_vectors(spark, sf), "embedding").select(F.round("norm", 5).alias("norm"), "n")


def _probs(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(F.transform(numeric.softmax(F.transform("embedding", lambda x: x.cast("double") * 8)), lambda p: F.round(p, 9))).alias("i", "prob"))


def top_k_crop(spark, sf):
    v = _vectors(spark, sf).select("vec_id", F.posexplode("embedding").alias("i", "logit"))
    return numeric.top_k_crop(v, "vec_id", 5).select("vec_id", "i")


def nucleus(spark, sf):
    return numeric.nucleus(_probs(spark, sf), "vec_id", 0.5).groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.max("prob"), 6).alias("top"))


def cdf_sample(spark, sf):
    return numeric.cdf_sample(_probs(spark, sf), "vec_id", (F.col("vec_id") * 37 % 101) / 101.0)


def xorshift(spark, sf):
    s, x = numeric.xorshift_star(F.col("vec_id") + 1)
    return _vectors(spark, sf).select("vec_id", s.alias("state"), x.alias("value"), numeric.unit_float(x).alias("coin"))


def prefix_bytes(spark, sf):
    """Bytes and documents within budgets, by language."""
    p = corpus_prefix(table(spark, sf, "documents"), 300_000).select("doc_id", F.octet_length("data").cast("long").alias("n"))
    return p.join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_bytes"))


def queries() -> dict:
    found = (
        log_val_curve, log_final_val, log_records, log_steps_once, log_target, convergence, equal_compute, metric_streams, stream_ranges, last_values, zscore_outliers, skip_updates, moving_average, ema_rate,
        lr_schedules, bytes_per_token_source, percent_gate, fixed_columns, done_markers, checkpoint_retention, harness_rollup, kernel_rollup, recent_mean, val_batches, auto_config, accumulation,
        utilisation, choice_render, choice_predictions, choice_accuracy, running_accuracy, label_accuracy, eval_stream, softmax_loss, softmax_rows, gelu_values, standardised, global_norm,
        top_k_crop, nucleus, cdf_sample, xorshift, prefix_bytes,
    )
    return {f.__name__: f for f in found}
