"""Multiple-choice examples: rendering, masks, losses and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENDINGS = 4


def render(examples: DataFrame, eot: int | None = None) -> DataFrame:
    """``example_id, label, choice, tokens, mask, targets``: context and ending in one row for each choice.

    ``examples`` has example_id, label, context and endings (token arrays). Rows of an example
    are padded with 0 to its longest; the mask is 1 on the ending. ``targets`` are the tokens
    moved by one, with 1 in ``target_mask`` where the next token belongs to the ending.
    """
    lead = F.array(F.lit(eot)) if eot is not None else F.array().cast("array<int>")
    d = examples.select("example_id", "label", "context", F.posexplode("endings").alias("choice", "ending"), F.array_max(F.transform("endings", F.size)).alias("__most"))
    ctx = F.concat(lead, F.col("context"))
    d = d.withColumn("__ctx", ctx).withColumn("__n", F.size("__ctx") + F.col("__most"))
    tokens = F.concat("__ctx", "ending", F.array_repeat(F.lit(0), F.col("__n") - F.size("__ctx") - F.size("ending")))
    mask = F.concat(F.array_repeat(F.lit(0), F.size("__ctx")), F.array_repeat(F.lit(1), F.size("ending")), F.array_repeat(F.lit(0), F.col("__n") - F.size("__ctx") - F.size("ending")))
    d = d.select("example_id", "label", "choice", F.size("__ctx").alias("context_len"), tokens.alias("tokens"), mask.alias("mask"))
    return d.withColumn("targets", F.slice("tokens", 2, 1 << 30)).withColumn("target_mask", F.slice("mask", 2, 1 << 30))


def choice_losses(rows: DataFrame) -> DataFrame:
    """``example_id, label, choice, sum_loss, mean_loss`` from ``losses`` under ``target_mask``."""
    kept = F.zip_with("losses", "target_mask", lambda x, m: F.when(m == 1, x).otherwise(F.lit(0.0)))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    n = F.aggregate("target_mask", F.lit(0), lambda a, m: a + m)
    return rows.select("example_id", "label", "choice", total.alias("sum_loss"), (total / n).alias("mean_loss"))


def predictions(losses: DataFrame) -> DataFrame:
    """``example_id, label, pred, pred_norm``: the choice of the least sum and of the least mean, the first of equals."""
    least = lambda c: F.min(F.struct(F.col(c).alias("x"), F.col("choice").alias("i")))["i"]
    return losses.groupBy("example_id", "label").agg(least("sum_loss").alias("pred"), least("mean_loss").alias("pred_norm"))


def accuracy(preds: DataFrame) -> DataFrame:
    return preds.agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("label")).cast("int")).alias("acc"), F.avg((F.col("pred_norm") == F.col("label")).cast("int")).alias("acc_norm"))


def running_accuracy(preds: DataFrame, partition: list[str], order: str, pred: str = "pred", label: str = "label") -> DataFrame:
    """``preds`` with ``n_seen`` and ``acc`` over the rows so far of each partition."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return preds.withColumn("n_seen", F.count("*").over(w)).withColumn("acc", F.avg((F.col(pred) == F.col(label)).cast("int")).over(w))


def eval_stream(rows: DataFrame, delimiter: int = 65_535) -> DataFrame:
    """``example_id, ints, n_bytes``: the 16-bit integers of each example in the evaluation file.

    delimiter, bytes of the example, its number, label, number of endings, context length and
    tokens, then each ending's length and tokens.
    """
    ends = F.aggregate("endings", F.array().cast("array<int>"), lambda acc, e: F.concat(acc, F.array(F.size(e)), e))
    body = F.concat(F.array(F.col("example_id").cast("int"), F.col("label").cast("int"), F.size("endings"), F.size("context")), F.col("context"), ends)
    n = (F.size(body) + 2) * 2
    return rows.select("example_id", F.concat(F.array(F.lit(delimiter), n), body).alias("ints"), n.alias("n_bytes"))
