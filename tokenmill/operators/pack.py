"""Packing token streams into fixed-size shards, and batches of shards, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.operators.prefix import running_sum


def with_eot(encoded: DataFrame, eot: int) -> DataFrame:
    """Token arrays that begin with the end-of-text token."""
    return encoded.withColumn("tokens", F.concat(F.array(F.lit(eot)), F.col("tokens")))


def pack(encoded: DataFrame, shard_size: int, key: str = "doc_id") -> DataFrame:
    """``key, shard, split, first, tokens, next_token``: each document's tokens cut at shard borders, in the order of keys.

    ``first`` is the place of the piece in its shard, next_token the document's token behind the piece (null at its end). Shard 0 is for validation. A document
    may straddle any number of shards; an empty last shard doesn't occur. Rows of a repeated key are packed one by one, those of a null key last.
    """
    d = encoded.select(key, "tokens", F.size("tokens").cast("long").alias("__n")).where("__n > 0")
    d = running_sum(d, key, "__n")
    last = F.floor((F.col("before") + F.col("__n") - 1) / shard_size)
    d = d.withColumn("shard", F.explode(F.sequence(F.floor(F.col("before") / shard_size), last)))
    begin = F.greatest(F.col("shard") * shard_size - F.col("before"), F.lit(0))
    end = F.least((F.col("shard") + 1) * shard_size - F.col("before"), F.col("__n"))
    return d.select(
        key,
        "shard",
        split_name(F.col("shard")).alias("split"),
        F.greatest(F.col("before") - F.col("shard") * shard_size, F.lit(0)).alias("first"),
        F.slice("tokens", (begin + 1).cast("int"), (end - begin).cast("int")).alias("tokens"),
        F.get("tokens", end.cast("int")).alias("next_token"),
    )


def split_name(shard: Column) -> Column:
    return F.when(shard == 0, "val").otherwise("train")


def prefix_split(pos: Column, n_val: int = 32_768) -> Column:
    """The first tokens are for validation."""
    return F.when(pos < n_val, "val").otherwise("train")


def manifest(packed: DataFrame) -> DataFrame:
    """``shard, split, n_tokens, n_docs``."""
    return packed.groupBy("shard", "split").agg(F.sum(F.size("tokens")).cast("long").alias("n_tokens"), F.count("*").alias("n_docs"))


def samples(n_tokens: Column, ranks: int, batch: int, length: int) -> Column:
    """Whole global batches of a shard."""
    return F.floor((n_tokens - 1) / (ranks * batch * length)).cast("long")


def check_manifest(shards: DataFrame, ranks: int, batch: int, length: int) -> DataFrame:
    """``shards`` with their samples and whether each holds at least one."""
    return shards.withColumn("samples", samples(F.col("n_tokens"), ranks, batch, length)).withColumn("valid", F.col("n_tokens") >= ranks * batch * length + 1)


def stream(packed: DataFrame, eot: int) -> DataFrame:
    """``shard, place, token, target``: one row for each token; the target of a document's last token is the end-of-text token that begins the next one."""
    d = packed.select("shard", "first", F.col("tokens").alias("t"), "next_token")
    pairs = F.zip_with("t", F.concat(F.slice("t", 2, 1 << 30), F.array(F.coalesce("next_token", F.lit(eot)))), lambda x, y: F.struct(x.alias("token"), y.alias("target")))
    return d.select("shard", "first", F.posexplode(pairs).alias("i", "p")).select("shard", (F.col("first") + F.col("i")).alias("place"), "p.token", "p.target")


def rows_of_batches(tokens: DataFrame, shards: DataFrame, ranks: int, batch: int, length: int) -> DataFrame:
    """``shard, sample, rank, row, col, token, target`` of all whole batches; the tail of a shard is dropped."""
    span = ranks * batch * length
    s = shards.select("shard", samples(F.col("n_tokens"), ranks, batch, length).alias("__samples"))
    d = tokens.join(s, "shard").withColumn("sample", F.floor(F.col("place") / span)).where(F.col("sample") < F.col("__samples"))
    inside = F.col("place") % span
    off = inside % (batch * length)
    return d.select("shard", "sample", F.floor(inside / (batch * length)).alias("rank"), F.floor(off / length).alias("row"), (off % length).alias("col"), "token", "target")


def resume(rows: DataFrame, shard: int, sample: int) -> DataFrame:
    """Batches from a cursor on."""
    return rows.where((F.col("shard") > shard) | ((F.col("shard") == shard) & (F.col("sample") >= sample)))


def totals(checked: DataFrame) -> DataFrame:
    """``split, shards, n_tokens, samples``: sums over the shards of a split."""
    return checked.groupBy("split").agg(F.count("*").alias("shards"), F.sum("n_tokens").alias("n_tokens"), F.sum("samples").alias("samples"))


def epoch_order(checked: DataFrame, epochs: int, seed: int | None = None) -> DataFrame:
    """``epoch, step, shard, sample``: the global batches of some epochs in the order in which they are read.

    All samples of a shard come before those of the next. With a seed, every epoch has its own
    order of shards, and every shard of it its own order of samples; without one both stand as
    they are. ``checked`` has one row for each shard (see ``check_manifest``).
    """
    d = checked.where("samples > 0").select("shard", "samples", F.explode(F.array(*map(F.lit, range(epochs)))).alias("epoch"))
    draw = lambda *by: F.xxhash64(F.lit(seed), *by) if seed is not None else F.lit(0)
    # one row for each shard and epoch: how many samples stand before
    shards = Window.partitionBy("epoch").orderBy(draw("epoch", "shard"), "shard")
    d = d.withColumn("__before", F.coalesce(F.sum("samples").over(shards.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("__all", F.sum("samples").over(Window.partitionBy("epoch")))
    d = d.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("samples") - 1)))
    inside = F.row_number().over(Window.partitionBy("epoch", "shard").orderBy(draw("epoch", "shard", "sample"), "sample")) - 1
    return d.select("epoch", (F.col("epoch") * F.col("__all") + F.col("__before") + inside).cast("long").alias("step"), "shard", "sample")


def eval_split(n: Column, ranks: int, batch: int) -> tuple[Column, Column]:
    """Examples for each rank, and batches of batch / 4 examples."""
    each = F.ceil(n / ranks).cast("long")
    return each, F.ceil(each / F.lit(batch // 4)).cast("long")


def accumulation_steps(total: Column, batch: int, length: int, ranks: int) -> Column:
    """Micro-batches for each step; the total must be a multiple of them."""
    return F.floor(total / (batch * length * ranks)).cast("long")
