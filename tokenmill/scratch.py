"""Tables written between jobs, in a folder that all executors share.

Iterative operators cut their lineage by writing a step and reading it back. The
folder is the one the cluster names in ``spark.checkpoint.dir``; only a local
session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for tables between jobs."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tokenmill-")
    return _local[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tokenmill/{label}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)
    if path in _written:
        _written.remove(path)


def drop_all(spark: SparkSession) -> None:
    """Delete every scratch table of this process, once no returned DataFrame is needed any more."""
    for path in list(_written):
        drop_path(spark, path)


#: Shuffle files go as soon as the query that wrote them has ended.
_FREE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for queries planned inside; the caller's come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, label: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write a step as Parquet and read it back; returns the table and its path. Its shuffle files are deleted."""
    spark = df.sparkSession
    path = new_path(spark, label)
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(partition_by)
    with settings(spark, _FREE):
        w.parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path), path


#: How tables of one number of buckets are joined: as they are stored, without a shuffle or a sort.
MERGE = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


class Sorted:
    """A written table in buckets by a hash of its first key, sorted by all keys in each, and partitioned by ``part``."""

    def __init__(self, df: DataFrame, label: str, buckets: int, keys: list[str], part: str):
        self.spark, self.schema, self.path = df.sparkSession, df.schema, new_path(df.sparkSession, label)
        self.name = f"tokenmill_{uuid.uuid4().hex}"
        w = df.write.format("parquet").partitionBy(part).bucketBy(buckets, keys[0]).sortBy(*keys)
        with settings(self.spark, _FREE | MERGE):
            w.option("path", self.path).option("compression", "zstd").saveAsTable(self.name)

    def merged(self) -> DataFrame:
        """To be joined under the MERGE settings."""
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """Without regard to the buckets."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def forget(self, *parts: str) -> None:
        """Drop the table and delete the named partitions; the others stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        for p in parts:
            drop_path(self.spark, f"{self.path}/{p}")
