"""MinHash signatures and locality-sensitive hashing of byte grams.

With b bands of r rows, grams of Jaccard similarity s share a bucket with probability
1 - (1 - s^r)^b: 0.947 at 0.8 and 0.001 at 0.3 for 16 bands of 8 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.bytesx import positional_features
from tokenmill.operators.components import connected_components

PRIME = 2**31 - 1
HASHES, BANDS = 128, 16
FOLD = 1_000_003


def parameters(hashes: int = HASHES, seed: int = 42) -> list[tuple[int, int]]:
    """Pairs (a, b) of the hash functions a * x + b, from the minimal-standard generator x -> 48271 x mod 2^31 - 1."""
    x, out = seed, []
    for _ in range(hashes):
        x = a = x * 48271 % PRIME
        x = b = x * 48271 % PRIME
        out.append((a, b))
    return out


def signature(features: Column, hashes: int = HASHES, seed: int = 42) -> Column:
    """Least value of every hash function over the features."""
    pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in parameters(hashes, seed)])
    return F.transform(pairs, lambda p: F.array_min(F.transform(features, lambda x: (p["a"] * x + p["b"]) % PRIME)))


def signatures(grams: DataFrame, hashes: int = HASHES, seed: int = 42) -> DataFrame:
    """``grams`` (``cand_id, token``) with ``sig``."""
    return grams.withColumn("features", positional_features(F.col("token"))).withColumn("sig", signature(F.col("features"), hashes, seed)).drop("features")


def band_rows(sigs: DataFrame, bands: int = BANDS, hashes: int = HASHES) -> DataFrame:
    """``cand_id, band, key``: each band's values folded into one number."""
    rows = hashes // bands
    key = lambda j: F.aggregate(F.slice("sig", j * rows + 1, rows), F.lit(0).cast("long"), lambda acc, x: (acc * FOLD + x) % PRIME)
    return sigs.select("cand_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.struct(j.alias("band"), key(j).alias("key")))).alias("b")).select("cand_id", "b.band", "b.key")


def buckets(rows: DataFrame) -> DataFrame:
    """``band, key, members, first_id`` of buckets with two members or more."""
    return rows.groupBy("band", "key").agg(F.count("*").alias("members"), F.min("cand_id").alias("first_id")).where("members >= 2")


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """``a, b`` (a < b): all pairs that share a bucket. For bounded candidate lists only: a bucket of m members has m (m - 1) / 2 pairs."""
    other = rows.withColumnRenamed("cand_id", "b")
    return rows.withColumnRenamed("cand_id", "a").join(other, ["band", "key"]).where("a < b").select("a", "b").distinct()


def star_edges(rows: DataFrame) -> DataFrame:
    """``a, b``: each bucket's first member with every other; reaches what all pairs reach with fewer rows."""
    return rows.join(buckets(rows).select("band", "key", "first_id"), ["band", "key"]).where("cand_id != first_id").select(F.col("first_id").alias("a"), F.col("cand_id").alias("b")).distinct()


def clusters(grams: DataFrame, rows: DataFrame) -> DataFrame:
    """``grams`` with ``cluster``, the smallest cand_id that is reachable over shared buckets."""
    found = connected_components(star_edges(rows)).withColumnsRenamed({"node": "cand_id", "root": "cluster"})
    return grams.join(found, "cand_id", "left").withColumn("cluster", F.coalesce("cluster", "cand_id"))


def jaccard_pairs(grams: DataFrame, least: float) -> DataFrame:
    """``a, b, shared, jaccard`` of pairs whose (place, byte) features have the similarity, by an equi-join on features that differ in no frequent one."""
    f = grams.select("cand_id", F.octet_length("token").alias("n"), F.explode(positional_features(F.col("token"))).alias("f"))
    a, b = f.select(F.col("cand_id").alias("a"), F.col("n").alias("na"), "f"), f.select(F.col("cand_id").alias("b"), F.col("n").alias("nb"), "f")
    shared = a.join(b, "f").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    return shared.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("jaccard") >= least).select("a", "b", "shared", "jaccard")
