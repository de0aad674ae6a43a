"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.scratch import drop_path, stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    low = low.select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = e.groupBy("u").agg(F.min("v").alias("low"))
    moved = e.join(low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", "low")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Nodes and the smallest node they reach.

    ``edges`` has two BIGINT columns, taken by position. Rounds of large star and
    small star hang every node from the smallest known neighbour; the number of
    rounds grows with the logarithm of a component's size. Each round is a written
    table, so a lost executor costs one round at most. A hub's edges are reduced
    by ``min`` before the shuffle; the joins are plain equi-joins that adaptive
    execution splits where one key is hot.

    Returns ``node, root`` for every node that has an edge to another node. Edges
    with a null end and loops are ignored; no edges give no rows.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u != v")
    now, path = stage(_small_star(e), "cc")
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
        after, new = stage(_small_star(_large_star(now)), "cc")
        drop_path(now.sparkSession, path)
        now, path = after, new
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
