"""Training logs: parsing, convergence and head-to-head comparison.

Lines are rows ``run, line_no, line``; a run's lines are ordered by number. A run of any size is
many tasks: windows are partitioned by run and by ranges of line numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.operators.prefix import ranges, same

# The formats of the trainers' lines; one trainer writes "| train loss", another "| loss".
TRAIN = r"step\s+(\d+).*(?:train|\|) loss\s+([\d.]+)"
VAL = r"val loss\s+([\d.]+)"
METRIC = r"^s:(\d+) (.*)$"


def read_log(spark, path: str) -> DataFrame:
    """Lines of text files, numbered within each file (one run)."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return d


def parsed(lines: DataFrame) -> DataFrame:
    """``run, line_no, step, train_loss, val_loss`` of the lines that have either."""
    group = lambda p, i: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    d = lines.select("run", "line_no", group(TRAIN, 1).cast("long").alias("step"), group(TRAIN, 2).cast("double").alias("train_loss"), group(VAL, 1).cast("double").alias("val_loss"))
    return d.where("step is not null or val_loss is not null")


def val_curve(rows: DataFrame) -> DataFrame:
    """``run, line_no, step, val_loss``: every val line takes the latest train step before it; those before any are dropped."""
    d = ranges(rows, "line_no", "__range")
    latest = d.groupBy(F.col("run").alias("__run"), F.col("__range").alias("__of")).agg(F.max_by("step", F.when(F.col("step").isNotNull(), F.col("line_no"))).alias("__step"))
    latest = latest.withColumn("__before", F.last("__step", ignorenulls=True).over(Window.partitionBy("__run").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)))
    d = d.join(latest, same([("run", "__run"), ("__range", "__of")]))
    w = Window.partitionBy("run", "__range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.last("step", ignorenulls=True).over(w), "__before"))
    return d.where("val_loss is not null and step is null and at is not null").select("run", "line_no", F.col("at").alias("step"), "val_loss")


def final_val(curve: DataFrame) -> DataFrame:
    return curve.groupBy("run").agg(F.max_by("val_loss", "line_no").alias("final_val"), F.max_by("step", "line_no").alias("final_step"))


def _opened(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ordinal``, how many lines of the run up to this one name a step, and ``__last``, how many do in all; those before any are dropped."""
    d = ranges(rows, "line_no", "__range")
    steps = d.groupBy(F.col("run").alias("__run"), F.col("__range").alias("__of")).agg(F.count("step").alias("__steps"))
    w = Window.partitionBy("__run")
    steps = steps.select("__run", "__of", F.coalesce(F.sum("__steps").over(w.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__steps").over(w).alias("__last"))
    d = d.join(steps, same([("run", "__run"), ("__range", "__of")]))
    inside = F.count("step").over(Window.partitionBy("run", "__range").orderBy("line_no"))
    return d.withColumn("ordinal", F.col("__before") + inside).where("ordinal > 0").drop("__range", "__run", "__of", "__before")


def records(rows: DataFrame) -> DataFrame:
    """``run, ordinal, step, train_loss, val_loss``: a train line and the first val line behind it; a last train line without one is dropped."""
    d = _opened(rows)
    first_val = F.min_by(F.when(F.col("step").isNull(), F.col("val_loss")), F.when(F.col("step").isNull() & F.col("val_loss").isNotNull(), F.col("line_no")))
    r = d.groupBy("run", "ordinal").agg(F.max("step").alias("step"), F.max(F.when(F.col("step").isNotNull(), F.col("train_loss"))).alias("train_loss"), first_val.alias("val_loss"), F.max("__last").alias("__last"))
    return r.where("val_loss is not null or ordinal < __last").drop("__last")


def steps_once(lines: DataFrame) -> DataFrame:
    """``run, step, val_loss``: any line that names a step opens it, and the first val line behind it takes it; others are dropped."""
    group = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    d = lines.select("run", "line_no", group(r"step\s+(\d+)").cast("long").alias("step"), group(VAL).cast("double").alias("val_loss")).where("step is not null or val_loss is not null")
    d = _opened(d)
    # a line with both takes its own step
    r = d.groupBy("run", "ordinal").agg(F.max("step").alias("step"), F.min_by("val_loss", F.when(F.col("val_loss").isNotNull(), F.col("line_no"))).alias("val_loss"))
    return r.where("val_loss is not null").select("run", "step", "val_loss")


def reached(recs: DataFrame, targets: DataFrame) -> DataFrame:
    """``run, target, step, val_loss, hit``: the first record at or below the target, else the one of the highest step (the first of equals). ``targets`` has run and target."""
    d = recs.where("val_loss is not null").join(targets, "run")
    s = F.struct("ordinal", "step", "val_loss")
    first = F.min_by(s, F.when(F.col("val_loss") <= F.col("target"), F.col("ordinal")))
    best = F.max_by(s, F.struct("step", -F.col("ordinal")))
    r = d.groupBy("run", "target").agg(first.alias("f"), best.alias("b"))
    use = F.coalesce("f", "b")
    return r.select("run", "target", use["step"].alias("step"), use["val_loss"].alias("val_loss"), F.col("f").isNotNull().alias("hit"))


def consumption(points: DataFrame, total_batch: int, bytes_per_token: str = "bytes_per_token") -> DataFrame:
    """With tokens, bytes and bits per byte at each point."""
    d = points.withColumn("n_tokens", F.col("step") * total_batch)
    return d.withColumn("n_bytes", F.col("n_tokens") * F.col(bytes_per_token)).withColumn("bpb", F.col("val_loss") / F.lit(math.log(2.0)) / F.col(bytes_per_token))


def head_to_head(points: DataFrame, base: str, other: str) -> DataFrame:
    """One row: bytes of either run, their ratio, the saving in percent and the winner (``base`` on ties)."""
    b = points.where(F.col("run") == base).select(F.col("n_bytes").alias("base_bytes"), F.col("bpb").alias("base_bpb"))
    o = points.where(F.col("run") == other).select(F.col("n_bytes").alias("other_bytes"), F.col("bpb").alias("other_bpb"))
    d = b.join(F.broadcast(o), F.lit(True))
    x, y = F.col("base_bytes"), F.col("other_bytes")
    return d.select("*", (x / y).alias("ratio"), (F.abs(x - y) / F.greatest(x, y) * 100).alias("saving_pct"), F.when(y < x, other).otherwise(base).alias("winner"))


def nearest(recs: DataFrame, at: DataFrame) -> DataFrame:
    """``run, at, step, val_loss``: each run's record whose step is nearest to ``at`` (one row), the first of equals."""
    d = recs.where("val_loss is not null").join(F.broadcast(at), F.lit(True))
    s = F.min_by(F.struct("step", "val_loss"), F.struct(F.abs(F.col("step") - F.col("at")), F.col("ordinal")))
    return d.groupBy("run", "at").agg(s.alias("r")).select("run", "at", "r.step", "r.val_loss")


def equal_step(recs: DataFrame) -> DataFrame:
    """One row ``at``: the smallest of the runs' highest steps."""
    return recs.groupBy("run").agg(F.max("step").alias("m")).agg(F.min("m").alias("at"))


def stream_values(lines: DataFrame) -> DataFrame:
    """``run, stream, step, value`` of metric lines (``s:10 trl:3.5 lr:0.1``); of repeated steps the last line counts."""
    d = lines.select("run", "line_no", F.regexp_extract("line", METRIC, 1).alias("s"), F.regexp_extract("line", METRIC, 2).alias("rest")).where("s != ''")
    d = d.select("run", "line_no", F.col("s").cast("long").alias("step"), F.explode(F.split("rest", " ")).alias("part")).where("part like '%:%'")
    d = d.select("run", "line_no", "step", F.substring_index("part", ":", 1).alias("stream"), F.substring_index("part", ":", -1).cast("double").alias("value"))
    return d.groupBy("run", "stream", "step").agg(F.max_by("value", "line_no").alias("value"))


def metric_lines(points: DataFrame) -> DataFrame:
    """``step, line``: lines of a metric log for rows ``step`` and any of ``eval``, ``val_loss`` and ``train_loss, lr, norm``; a null value gives no line."""
    has = set(points.columns)
    line = lambda name, *parts: F.when(F.col(name).isNotNull(), F.concat(F.format_string("s:%d", "step"), *[F.format_string(f" {p}", c) for p, c in parts]))
    # Names and decimals of the streams.
    kinds = [
        line("eval", ("eval:%.4f", "eval")) if "eval" in has else None,
        line("val_loss", ("tel:%.4f", "val_loss")) if "val_loss" in has else None,
        line("train_loss", ("trl:%.4f", "train_loss"), ("lr:%.6f", "lr"), ("norm:%.2f", "norm")) if "train_loss" in has else None,
    ]
    return points.select("step", F.explode(F.array_compact(F.array(*[k for k in kinds if k is not None]))).alias("line"))


def append_metrics(points: DataFrame, folder: str, fresh: bool = False) -> None:
    """Append the lines of some steps, in the order of steps, to a log, a folder of text files; ``fresh`` begins a new one."""
    lines = metric_lines(points).sort("step").select(F.col("line").alias("value"))
    lines.write.mode("overwrite" if fresh else "append").text(folder)


def stream_ranges(values: DataFrame) -> DataFrame:
    return values.groupBy("stream").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def bytes_per_token(override: str, measured: str, default: float):
    """The first that is known: an override, a measurement, a default."""
    return F.coalesce(F.col(override), F.col(measured), F.lit(default))


def percent_gate(found: DataFrame, golden: DataFrame, percent: float) -> DataFrame:
    """``idx, found, golden, diff_pct, ok`` from two tables ``idx, value``."""
    g = golden.withColumnRenamed("value", "golden")
    d = found.withColumnRenamed("value", "found").join(g, "idx", "full_outer")
    pct = F.abs(F.col("found") - F.col("golden")) / F.nullif(F.abs("golden"), F.lit(0.0)) * 100
    return d.select("idx", "found", "golden", pct.alias("diff_pct"), F.coalesce(pct <= percent, F.lit(False)).alias("ok"))


def fixed_columns(lines: DataFrame, marker: str, begin: int, width: int, n: int = 10) -> DataFrame:
    """``run, idx, value``: numbers in fixed columns of the ``n`` lines from the first with a marker on."""
    first = lines.where(F.col("line").contains(marker)).groupBy("run").agg(F.min("line_no").alias("__from"))
    d = lines.join(first, "run").withColumn("idx", F.col("line_no") - F.col("__from")).where((F.col("idx") >= 0) & (F.col("idx") < n))
    return d.select("run", "idx", F.try_to_number(F.trim(F.substring("line", begin, width)), F.lit("999999.999999")).cast("double").alias("value"))


def highest_done(paths: DataFrame) -> DataFrame:
    """The highest step of the ``DONE_<step>`` markers among paths, or null."""
    return paths.agg(F.max(F.nullif(F.regexp_extract("path", r"DONE_(\d+)$", 1), F.lit("")).cast("long")).alias("max_step"))
