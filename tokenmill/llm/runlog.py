"""Incremental substring dedup over a log-structured fingerprint index.

The index is a list of immutable runs, one for each batch of documents. A run has, for every
different stretch of windows of its batch, the hash of its gram, a digest and the first document
with it; it is stored sorted by hash, in buckets of it. A new batch is shuffled and sorted once,
to become the next run. That run is merge-joined with each earlier one, as they are stored:
neither side is shuffled or sorted again. Stretches that an earlier run has are settled;
stretches that share a gram but differ are verified window by window on their words. Before a
batch comes, neighbouring runs are compacted until there are at most ``max_runs``: two runs are
merged into one that keeps the first document of each stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.repeats import DUP, FIRST, MORE, PIECE, RESULT_NAMES, Spec, finish, hot_windows, keyed, meet, run_rows, split
from tokenmill.llm.texts import prepare
from tokenmill.scratch import MERGE, Sorted, drop_path, settings, stage

SPEC = Spec(window=13, gram=6, words=True, strict=True)
MAX_RUNS = 2
BATCHES = 4
#: Pieces of one gram that one task compares; more meet window by window.
HOT = 1 << 11
_KEYS = ["h", "digest"]
_FOUND = ["kind", "h", "dk", "tk", "at", "starts"]


class RunLog:
    """Sorted runs of window fingerprints of all documents that have been added."""

    def __init__(self, spark: SparkSession, spec: Spec = SPEC, max_runs: int = MAX_RUNS):
        self.spark, self.spec, self.max_runs = spark, spec, max_runs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[Sorted, int]] = []  # with their rows, oldest first
        self.merges = 0

    def add(self, batch: DataFrame) -> list[DataFrame]:
        """Make a run of a batch (see ``repeats.keyed``) and merge-join it with the earlier runs.

        Returns settled rows (DUP) and open pieces (PIECE), of the batch and of earlier documents
        that it must be compared with.
        """
        while len(self.runs) > self.max_runs:
            self.compact()
        met = meet(run_rows(batch, self.spec), self.spec.strict, True, self.buckets)
        run = Sorted(met, "log-run", self.buckets, _KEYS, "kind")
        with settings(self.spark, MERGE):
            new, _ = stage(self._compared(run, FIRST).union(self._compared(run, MORE)), "log-met")
            # grams of the batch's open stretches that earlier runs have as well
            open_grams = new.where((F.col("kind") == PIECE) & F.col("shared")).select("h").distinct()
            old = []
            for one, _ in self.runs:
                rows = one.merged().where(F.col("kind") == FIRST).join(open_grams, "h", "left_semi")
                old.append(stage(rows.select(F.lit(PIECE).alias("kind"), *_FOUND[1:]), "log-old")[0])
        self.runs.append((run, run.rows().where(F.col("kind") == FIRST).count()))
        return [run.rows().where(F.col("kind") == DUP).select(*_FOUND), new.select(*_FOUND), *old]

    def _compared(self, run: Sorted, kind: int) -> DataFrame:
        """Rows of a new run that earlier ones settle, or that share their gram with different ones; ``shared``: with such of earlier runs."""
        rows, known, shared = run.merged().where(F.col("kind") == kind).drop("kind"), F.lit(False), F.lit(False)
        olds = [one.merged().where(F.col("kind") == FIRST).select(*_KEYS) for one, _ in self.runs]
        for k, old in enumerate(olds):
            rows = rows.join(old.withColumn(f"same{k}", F.lit(True)).hint("merge"), _KEYS, "left")
            known = known | F.col(f"same{k}").isNotNull()
        for k, old in enumerate(olds):
            rows = rows.join(old.select("h").distinct().withColumn(f"gram{k}", F.lit(True)).hint("merge"), "h", "left")
            shared = shared | F.col(f"gram{k}").isNotNull()
        rows = rows.withColumns({"known": known, "shared": shared & ~known}).where(F.col("known") | F.col("shared") | (F.col("sub") > 0))
        no_hash = F.when(F.col("known"), F.lit(0).cast("long")).otherwise(F.col("h")).alias("h")
        return rows.select(F.when(F.col("known"), DUP).otherwise(PIECE).alias("kind"), no_hash, "dk", "tk", "at", "starts", "shared")

    def compact(self) -> None:
        """Merge the two neighbouring runs of the fewest rows into one, with the first document of each stretch."""
        k = min(range(len(self.runs) - 1), key=lambda i: self.runs[i][1] + self.runs[i + 1][1])
        (a, _), (b, _) = self.runs[k : k + 2]
        rest = ["sub", "dk", "tk", "at", "starts"]
        with settings(self.spark, MERGE):
            old, new = (x.merged().where(F.col("kind") == FIRST).select(*_KEYS, F.struct(*rest).alias(n)) for x, n in ((a, "old"), (b, "new")))
            both = old.hint("merge").join(new, _KEYS, "full").select(*_KEYS, F.coalesce("old", "new").alias("r"))
            merged = Sorted(both.select(*_KEYS, "r.*", F.lit(FIRST).alias("kind")), "log-run", self.buckets, _KEYS, "kind")
        for x in (a, b):
            x.forget(f"kind={FIRST}", f"kind={MORE}")
        self.runs[k : k + 2] = [(merged, merged.rows().count())]
        self.merges += 1

    def close(self) -> None:
        """Delete all runs; settled rows stay."""
        for run, _ in self.runs:
            run.forget(f"kind={FIRST}", f"kind={MORE}")
        self.runs = []


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of pieces whose words an earlier document's piece of the same gram has. Pieces come sorted by gram, dk and tk."""
    window, group, first = SPEC.window, None, {}
    for b in batches:
        dks, tks, lists, sizes = [], [], [], []
        for h, dk, tk, starts, size, body in zip(*(b.column(c).to_pylist() for c in ("h", "dk", "tk", "starts", "size", "body")), strict=True):
            if h != group:
                group, first = h, {}
            words = body.split(b" ")
            run = 0
            for j in range(size + 1):
                if j < size and first.setdefault(b" ".join(words[j : j + window]), dk) < dk:
                    run += 1
                elif run:
                    dks.append(dk)
                    tks.append(tk)
                    lists.append([s + j - run for s in starts])
                    sizes.append(run)
                    run = 0
        if dks:
            yield pa.RecordBatch.from_arrays([pa.array(dks, pa.int64()), pa.array(tks, pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array(sizes, pa.int32())], ["dk", "tk", "starts", "size"])


def batches_by_id(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Documents in ranges of ascending doc_id, about equal in number; null ids are in the last one."""
    if batches < 2:
        return [docs]
    cuts = sorted(set(docs.agg(F.percentile_approx("dk", [i / batches for i in range(1, batches)], 1000)).first()[0] or []))
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = docs if low is None else docs.where(F.col("dk") > low)
        out.append(part if high is None else part.where(F.col("dk") <= high))
    return out


def substring_dedup(docs: DataFrame, batches: int = BATCHES, max_runs: int = MAX_RUNS, keep: bool = False) -> DataFrame:
    """``doc_id, n, n_removed, kept_sha256, kept``, one row for each row of ``docs``.

    Words are runs of characters other than 0x20 and 0x09 to 0x0D, unchanged (null: none). A
    word goes if a window of 13 words that covers it also starts in a document of a smaller
    doc_id; windows are judged on the input. Documents are added to the index in ``batches``
    ranges of ascending doc_id, as they would arrive. ``kept`` has the kept words joined by one
    space if ``keep`` is set (null for a null text). Null doc_ids come after all others and
    count as one document, as do rows that share a doc_id: they lose nothing to each other.
    Texts of fewer than 13 words lose nothing, an empty table gives no rows, and further columns are ignored.
    """
    prepare(docs, "doc_id", "text")
    docs = keyed(docs)
    log, met = RunLog(docs.sparkSession, SPEC, max_runs), None
    for batch in batches_by_id(docs, batches):
        for rows in log.add(batch):
            met = rows if met is None else met.union(rows)
    log.close()
    parts, _ = stage(split(docs, met.withColumn("sub", F.lit(0)), SPEC, keep), "log-split", "kind")
    pieces = parts.where("kind = 1").select("h", "dk", "tk", "starts", "size", "body")
    # one row for each gram of many pieces; these meet window by window
    hot, _ = stage(pieces.groupBy("h").count().where(F.col("count") > HOT).select("h"), "log-hot")
    cold = pieces.join(hot, "h", "left_anti")
    late = cold.repartition("h").sortWithinPartitions("h", "dk", "tk").mapInArrow(_verify, "dk long, tk int, starts array<int>, size int")
    many = hot_windows(pieces, hot, SPEC)
    late = late if many is None else late.union(many)
    done = parts.where("kind = 0").select(*RESULT_NAMES)
    all_rows = done.union(finish(parts.where("kind = 2").select("doc_id", "dk", "tk", "text", "rest", "known"), late, SPEC, keep))
    return all_rows.select("doc_id", "n", "n_removed", "kept_sha256", "kept")
