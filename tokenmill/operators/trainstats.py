"""Statistics of training metrics: z-scores, averages, update and retention rules, rollups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.operators.prefix import numbered, overlapping, same

WINDOW = 128


def zscores(df: DataFrame, partition: list[str], order: str, value: str, window: int = WINDOW, out: str = "z") -> DataFrame:
    """``df`` with the z-score of a value among the last ``window`` rows, itself included; null for the first ``window`` rows, 0 without deviation.

    A partition is dealt to blocks of rows that overlap by a window, so one of any size is many tasks.
    """
    d = overlapping(numbered(df, partition, order, "__k"), "__k", window - 1, 0)
    f = Window.partitionBy(*partition, "__block").orderBy("__k").rowsBetween(-(window - 1), 0)
    sd = F.stddev_pop(value).over(f)
    z = F.when(sd == 0, 0.0).otherwise((F.col(value) - F.avg(value).over(f)) / sd)
    return d.withColumn(out, F.when(F.col("__k") > window, z)).where("__home").drop("__k", "__block", "__home")


def skip_update(z_loss: Column, z_grad: Column, loss_limit: float, grad_limit: float) -> Column:
    """Whether an update is skipped: an enabled (non-zero) limit is exceeded by a known, finite score."""
    over = lambda z, limit: F.coalesce(z.isNotNull() & ~F.isnan(z) & (z > limit), F.lit(False)) if limit else F.lit(False)
    return over(z_loss, loss_limit) | over(z_grad, grad_limit)


def moving_average(df: DataFrame, partition: list[str], order: str, value: str, half: int, out: str = "smooth") -> DataFrame:
    """``df`` with the centred mean over 2 half + 1 rows; beyond the ends the edge values repeat. Partitions are dealt to blocks that overlap by ``half`` rows on either side."""
    numbers, names = numbered(df, partition, order, "__k"), [f"__p{i}" for i in range(len(partition))]
    ends = numbers.groupBy(*[F.col(c).alias(n) for c, n in zip(partition, names, strict=True)]).agg(F.count("*").alias("__n"), F.min_by(value, "__k").alias("__first"), F.max_by(value, "__k").alias("__last"))
    d = overlapping(numbers, "__k", half, half)
    f = Window.partitionBy(*partition, "__block").orderBy("__k").rowsBetween(-half, half)
    d = d.withColumn("__sum", F.sum(value).over(f)).where("__home").join(ends, same(list(zip(partition, names, strict=True))))
    left = F.greatest(F.lit(0), half + 1 - F.col("__k"))
    right = F.greatest(F.lit(0), F.col("__k") + half - F.col("__n"))
    total = F.col("__sum") + left * F.col("__first") + right * F.col("__last")
    return d.withColumn(out, total / (2 * half + 1)).drop("__k", "__block", "__home", "__sum", "__n", "__first", "__last", *names)


def ema(df: DataFrame, partition: list[str], order: str, value: str, decay: float = 0.95, out: str = "ema") -> DataFrame:
    """``df`` with the bias-corrected exponential mean of a value; 0 < ``decay`` < 1.

    After k rows it is (1 - d) * sum of d^(k-i) x_i over 1 - d^k; a null value counts as 0. Rows
    are cut into blocks in which d^-i stays small: a running sum of x_i d^-i gives the part of a
    row's own block, and the parts of earlier blocks come from the blocks' sums, as far back as
    their weight isn't zero in double precision. So no row is left out that could count.
    """
    size = max(1, int(math.log(1e6) / -math.log(decay)))
    reach = math.ceil(math.log(5e-324) / (size * math.log(decay))) + 1
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * (1 - decay)
    d = numbered(df, partition, order, "__k")
    d = d.withColumn("__block", F.floor((F.col("__k") - 1) / size)).withColumn("__j", (F.col("__k") - 1) % size)
    inside = Window.partitionBy(*partition, "__block").orderBy("__j").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__own", F.sum(x * F.pow(F.lit(decay), -F.col("__j"))).over(inside) * F.pow(F.lit(decay), F.col("__j")))
    ends = d.groupBy(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(partition)], F.col("__block").alias("__of")).agg(F.max_by("__own", "__j").alias("__end"))
    names = [f"__p{i}" for i in range(len(partition))]
    before = F.collect_list("__end").over(Window.partitionBy(*names).orderBy("__of").rowsBetween(-reach, -1))
    ends = ends.withColumn("__before", before).select(*names, "__of", F.aggregate("__before", F.lit(0.0), lambda acc, e: acc * decay**size + e).alias("__carry"))
    joined = d.join(ends, same([*zip(partition, names, strict=True), ("__block", "__of")]))
    total = F.col("__own") + F.col("__carry") * F.pow(F.lit(decay), F.col("__j") + 1)
    return joined.withColumn(out, total / (1 - F.pow(F.lit(decay), F.col("__k")))).drop("__k", "__block", "__j", "__own", "__of", "__carry", *names)


def keep_checkpoint(step: Column, now: Column, keep: int, every: int, major: int) -> Column:
    """Whether a checkpoint stays: among the last ``keep``, or a multiple of ``major`` (0: none)."""
    recent = step > now - keep * every
    return recent | ((step % major == 0) if major else F.lit(False))


def harness_summary(results: DataFrame) -> DataFrame:
    """``task, score`` of rows ``task, value`` (mean times 100), and a row ``average`` over the tasks."""
    tasks = results.groupBy("task").agg((F.avg("value") * 100).alias("score"))
    return tasks.unionByName(tasks.agg(F.lit("average").alias("task"), F.avg("score").alias("score")).select("task", "score"))


def kernel_passes(kernels: DataFrame, order: str, layers: int = 12, head: int = 6) -> DataFrame:
    """Kernels of one profiled step with ``phase``, ``times`` and ``name``; times and amounts are scaled by ``times``.

    Phases: ``enc`` for encoder kernels; ``cls`` for the ``head`` kernels from the second before
    the last fused classifier on; ``opt`` for optimiser kernels; ``init`` (which counts 0 times)
    for others behind the encoder's backward kernels; else ``fwd`` or, behind the head, ``bwd``,
    which stand for ``layers`` layers. ``name`` is the function without its type, template and
    arguments, matmul kernels in one group. A step without a classifier has no head. A profile
    has some hundred kernels, so one window over them is bounded.
    """
    w = Window.orderBy(order)
    has = lambda s: F.col("kernel").contains(s)
    d = kernels.withColumn("__i", F.row_number().over(w))
    whole = Window.orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("__cls", F.max(F.when(has("fused_classifier"), F.col("__i"))).over(whole) - 2)
    in_head = F.coalesce((F.col("__i") >= F.col("__cls")) & (F.col("__i") < F.col("__cls") + head), F.lit(False)) & ~has("encoder")
    so_far = Window.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    # the head sets the phase to backward; an encoder kernel behind it ends the layers
    d = d.withColumn("__head", in_head)
    d = d.withColumn("__behind", F.max(F.col("__head")).over(so_far)).withColumn("__ended", F.max(F.col("__behind") & has("encoder")).over(so_far))
    optimiser = has("adamw") | has("global_norm") | has("copy_and_cast")
    phase = F.when(has("encoder"), "enc").when(F.col("__head"), "cls").when(optimiser, "opt").when(F.col("__ended"), "init").when(F.col("__behind"), "bwd").otherwise("fwd")
    d = d.withColumn("phase", phase).withColumn("times", F.when(F.col("phase").isin("fwd", "bwd"), layers).when(F.col("phase") == "init", 0).otherwise(1))
    # "init" rows keep their own figures; they only count no time
    scale = F.when(F.col("times") > 1, F.col("times")).otherwise(1)
    words = F.split(F.substring_index("kernel", "(", 1), " ")
    name = F.substring_index(F.when(F.size(words) > 1, F.get(words, F.lit(1))).otherwise(F.get(words, F.lit(0))), "<", 1)
    for group in ("ampere_bf16", "cudnn_generated_fort_native_sdpa"):
        name = F.when(name.startswith(group), group).otherwise(name)
    amounts = [c for c in ("time_ms", "read_gb", "write_gb", "l2_read", "l2_write", "instructions") if c in kernels.columns]
    return d.withColumns({c: F.col(c) * scale for c in amounts} | {"name": name}).drop("__i", "__cls", "__head", "__behind", "__ended")


def kernel_summary(kernels: DataFrame) -> DataFrame:
    """Rows by kernel and pass: calls, time, bytes, share of the time, time-weighted utilisation, most bandwidth; and totals by pass and overall."""
    d = kernels.withColumn("bandwidth", (F.col("read_gb") + F.col("write_gb")) / F.col("time_ms") * 1000)
    s = d.rollup("phase", "kernel").agg(F.count("*").alias("calls"), F.sum("time_ms").alias("time_ms"), F.sum("read_gb").alias("read_gb"), F.sum("write_gb").alias("write_gb"), (F.sum(F.col("tensor_pct") * F.col("time_ms")) / F.sum("time_ms")).alias("tensor_pct"), F.max("bandwidth").alias("max_bandwidth"))
    total = F.broadcast(d.agg(F.sum("time_ms").alias("__all")))
    return s.join(total, F.lit(True)).withColumn("share", F.col("time_ms") / F.col("__all")).drop("__all")


def by_time(summary: DataFrame) -> DataFrame:
    """Rows of a kernel summary, those of the most time first."""
    return summary.orderBy(F.desc("time_ms"), "phase", "kernel")


def mean_of_last(df: DataFrame, order: str, value: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n).agg(F.avg(value).alias("mean_last"))


def mean_of_batches(df: DataFrame, rank: str, order: str, value: str, steps: int) -> DataFrame:
    """Mean over each rank's first batches, then over ranks."""
    k = F.row_number().over(Window.partitionBy(rank).orderBy(order))
    each = df.withColumn("__k", k).where(F.col("__k") <= steps).groupBy(rank).agg(F.avg(value).alias("m"))
    return each.agg(F.avg("m").alias("mean_loss"), F.count("*").alias("ranks"))


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The first name whose threshold the value reaches."""
    out = None
    for least, name in steps:
        out = F.when(value >= least, name) if out is None else out.when(value >= least, name)
    return out.otherwise(otherwise)
