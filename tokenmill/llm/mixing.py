"""Mixing sources to target weights, in DataFrame operations only.

Every source gets a target of words. A source gives whole epochs of itself first; the
rest of its target is filled by Efraimidis-Spirakis sampling: each document gets the key
-ln(u) / w of its quality weight w and a uniform u hashed from its id, documents are taken
in the order of their keys, and a prefix sum over their sizes stops at the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.texts import prepare
from tokenmill.scratch import stage

WORD = r"[^\x20\x09-\x0D]+"
RATIOS = (5, 2, 1)
TOTAL = 1.5
CAP = 2
SEED = "mix-1"
#: Rows up to which the table of sources is broadcast; more are joined by shuffle.
BROADCAST_ROWS = 20_000


def targets(sizes: DataFrame, ratios: tuple[int, ...] = RATIOS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """``source, source_size, n, weight, rank, target`` from one row for each source.

    ``sizes`` has source, source_size, n and weight. Sources by code point, null last, get
    the ratios in turn and share ``total`` times all sizes; a target stops at ``cap`` times its
    source's size, and the excess is shared anew until none is above. That is the level L at
    which min(cap, L * ratio) sums to the total, found from prefix sums in the order of
    cap / ratio. The windows here see one row for each source, never documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(float(r)) for r in ratios])
    s = sizes.withColumn("rank", F.row_number().over(by_name).cast("long"))
    s = s.withColumn("ratio", F.element_at(turn, ((F.col("rank") - 1) % len(ratios) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("most") / F.col("ratio"), "rank")
    before, all_rows = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) * F.lit(float(total)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("ratio").over(all_rows) - F.coalesce(F.sum("ratio").over(before), F.lit(0.0))))
    reached = F.when(F.col("most") / F.col("ratio") >= F.col("level"), F.col("level"))
    s = s.withColumn("level", F.first(reached, ignorenulls=True).over(all_rows))
    return s.select("source", "source_size", "n", "weight", "rank", F.coalesce(F.least("most", F.col("level") * F.col("ratio")), "most").alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, ratios: tuple[int, ...] = RATIOS, total: float = TOTAL, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, epochs``, one row for each row of ``docs``.

    ``docs`` has doc_id, text and source; ``quality`` may give doc_id and a positive
    weight (default 1; rows of no or null weight have 1). size is the number of words of the
    text (null: 0). A source with target t takes floor(t / source_size) epochs, and of the
    rest as much as fits: documents in key order, the last one cut at the budget, so that a
    source's taken words are its target rounded down. No document exceeds ``cap`` times its
    size. Ties and repeated rows are ordered by doc_id and size and never lost; a null doc_id
    is hashed as an empty one, a null source is a source of its own (last); sources without
    words take 0. The order depends on ids and the seed alone, so reruns agree. An empty
    table gives no rows, and further columns are ignored.

    A hot source does not meet in one task: its keys are cut into about sqrt(n) ranges, a
    window sums within each range, and a second one over the ranges' totals adds the offsets.
    """
    prepare(docs, "doc_id", "text", "source")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    if quality is None:
        base = base.withColumn("weight", F.lit(1.0))
    else:
        q = quality.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("weight").cast("double").alias("weight")).groupBy("doc_id").agg(F.max("weight").alias("weight"))
        base = base.join(q, "doc_id", "left").withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0)))
    base, _ = stage(base, "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("weight").alias("weight"))
    plan, _ = stage(targets(sizes, ratios, total, cap).withColumnRenamed("weight", "mean_weight"), "mix-targets")
    small = F.broadcast(plan) if plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else plan
    d = base.join(small.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    d = d.withColumn("key", -F.log(u) / F.col("weight"))
    ranges = F.ceil(F.sqrt("n"))
    d = d.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key") * F.col("mean_weight"))) * ranges), ranges - 1))
    within = Window.partitionBy("rank", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("rank", "range").agg(F.sum("size").alias("words")).select("rank", "range", F.coalesce(F.sum("words").over(below), F.lit(0)).alias("offset"))
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["rank", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("offset") - F.col("inside")))
    return d.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), epochs.alias("epochs"))
