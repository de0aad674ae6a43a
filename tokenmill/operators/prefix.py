"""Running sums over a whole table without one task seeing all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14


def running_sum(df: DataFrame, key: str, value: str, out: str = "before", block: int = BLOCK) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows that stand before in the order of ``key`` (a BIGINT).

    Keys are cut into ranges of one width, so many that a range has about ``block`` rows where
    keys are spread evenly, dense or sparse. A window sums within each range; a second one over
    the ranges' totals, one row for each range, adds what stands before it. Rows of one key stand
    in any order among themselves, those without a key behind all others; none is lost or doubled.
    """
    d = ranges(df, key, "__block", block)
    inside = Window.partitionBy("__block").orderBy(F.asc_nulls_last(key)).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy(F.asc_nulls_last("__of")).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(F.col("__block").alias("__of")).agg(F.sum(value).alias("__total"))
    totals = totals.select("__of", F.coalesce(F.sum("__total").over(below), F.lit(0)).alias("__below"))
    d = d.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    d = d.join(totals, F.col("__block").eqNullSafe(F.col("__of")))
    return d.withColumn(out, (F.col("__below") + F.col("__inside")).cast("long")).drop("__block", "__of", "__inside", "__below")


def same(pairs: list[tuple[str, str]]) -> Column:
    """Whether columns are equal pair by pair, null to null."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs], F.lit(True))


def ranges(df: DataFrame, key: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the range of ``key`` (a BIGINT), of one width, so many that a range has about ``block`` rows where keys are spread evenly; null for null."""
    span = df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).first()
    low, high = float(span["low"] or 0), float(span["high"] or 0)
    width = max(1.0, (high - low) / max(1.0, span["n"] / block))
    return df.withColumn(out, F.floor((F.col(key).cast("double") - low) / width))


def numbered(df: DataFrame, partition: list[str], order: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the place of each row, from 1, in its partition by ``order`` (a BIGINT), null last.

    A partition of any size is numbered in ranges of its keys, so that no task sorts all of it:
    places within each range, and one window over the ranges' sizes.
    """
    d = ranges(df, order, "__range", block)
    names = [f"__in{i}" for i in range(len(partition))]
    sizes = d.groupBy(*[F.col(c).alias(n) for c, n in zip(partition, names, strict=True)], F.col("__range").alias("__of")).agg(F.count("*").alias("__size"))
    below = Window.partitionBy(*names).orderBy(F.asc_nulls_last("__of")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*names, "__of", F.coalesce(F.sum("__size").over(below), F.lit(0)).alias("__below"))
    d = d.withColumn("__place", F.row_number().over(Window.partitionBy(*partition, "__range").orderBy(F.asc_nulls_last(order))))
    d = d.join(sizes, same([*zip(partition, names, strict=True), ("__range", "__of")]))
    return d.withColumn(out, F.col("__below") + F.col("__place")).drop("__range", "__of", "__place", "__below", *names)


def overlapping(df: DataFrame, place: str, before: int, behind: int, block: int = BLOCK) -> DataFrame:
    """``df`` dealt to ``__block``s of ``block`` places, each with the rows of ``before`` places ahead of it and ``behind`` places past it; ``__home`` marks a row's own block."""
    block = max(block, before, behind)
    own, at = F.floor((F.col(place) - 1) / block), (F.col(place) - 1) % block
    blocks = F.array_compact(F.array(own, F.when(at >= block - before, own + 1), F.when((at < behind) & (own > 0), own - 1)))
    return df.withColumn("__block", F.explode(blocks)).withColumn("__home", F.col("__block") == own)
