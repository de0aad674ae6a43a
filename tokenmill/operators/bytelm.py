"""Byte language models of order 1 to 3, surprise, and boundaries.

Counts are sparse tables. Their size is bounded by the alphabet (256, 65,536 and 16,777,216
rows at most), which bounds what scoring broadcasts. Contexts never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.bytesx import to_bytes
from tokenmill.operators.ngrams import flat, ngram_counts


class ByteLM:
    """Counts of single bytes, pairs and (order 3) triples, for scoring with Laplace smoothing."""

    def __init__(self, uni: np.ndarray, bi: np.ndarray, keys: np.ndarray, counts: np.ndarray, order: int = 3):
        self.uni, self.bi, self.order = uni, bi, order
        self.keys, self.counts = keys, counts  # of triples, sorted
        self.total = int(uni.sum())
        self.rows = bi.sum(1)
        self.contexts = np.zeros(65536, np.int64)
        np.add.at(self.contexts, keys >> 8, counts)

    def surprise(self, data: np.ndarray) -> np.ndarray:
        """float32 surprise of every byte but the first, given up to two bytes before it."""
        x = data.astype(np.int64)
        if len(x) < 2:
            return np.zeros(0, np.float32)
        if self.order == 1:
            return (-np.log((self.uni[x[1:]] + 1) / (self.total + 256))).astype(np.float32)
        h = -np.log((self.bi[x[:-1], x[1:]] + 1) / (self.rows[x[:-1]] + 256))
        if self.order >= 3 and len(x) > 2:
            context = x[:-2] << 8 | x[1:-1]
            key = context << 8 | x[2:]
            i = np.searchsorted(self.keys, key)
            i[i == len(self.keys)] = 0
            c = np.where(self.keys[i] == key, self.counts[i], 0) if len(self.keys) else np.zeros(len(key), np.int64)
            h[1:] = -np.log((c + 1) / (self.contexts[context] + 256))
        return h.astype(np.float32)

    def surprising(self, tau: np.float32) -> tuple[np.ndarray, np.ndarray]:
        """Whether each triple's third byte, or each pair's second, exceeds ``tau``: tables to look up places of texts in. For order 1 and 2 the first is the pairs'."""
        every = np.arange(256, dtype=np.uint8)
        pairs = np.stack([self.surprise(np.array([c, x], np.uint8))[0] > tau for c in every for x in every]).ravel() if self.order == 1 else (-np.log((self.bi + 1) / (self.rows[:, None] + 256))).astype(np.float32).ravel() > tau
        if self.order < 3:
            return pairs, pairs
        table = np.repeat((-np.log(1 / (self.contexts + 256))).astype(np.float32) > tau, 256)
        table[self.keys] = (-np.log((self.counts + 1) / (self.contexts[self.keys >> 8] + 256))).astype(np.float32) > tau
        return table, pairs

    def associations(self) -> list[list[float]]:
        """log P(byte given the one before) - log P(byte), by both bytes."""
        return (np.log((self.bi + 1) / (self.rows[:, None] + 256)) - np.log((self.uni + 1) / (self.total + 256))).tolist()

    def pmi(self, token: bytes, table: list[list[float]] | None = None) -> float:
        """Sum of the associations of the bytes after the first; ``table`` saves to compute them for each token."""
        if table is None:
            table = self.associations()
        return sum((table[a][b] for a, b in zip(token, token[1:], strict=False)), 0.0)


def lm_counts(docs: DataFrame, order: int = 3, text: str = "text") -> DataFrame:
    """``n, gram, freq`` for n = 1 to ``order``."""
    return ngram_counts(docs, tuple(range(1, order + 1)), text)


def load_lm(counts: DataFrame, order: int = 3) -> ByteLM:
    """A model on the driver, from at most 256 + 65,536 + 16,777,216 counts."""
    t = counts.select("n", F.conv("gram", 16, 10).cast("long").alias("key"), "freq").toArrow()
    n, key, freq = (t.column(i).to_numpy() for i in range(3))
    uni, bi = np.zeros(256, np.int64), np.zeros((256, 256), np.int64)
    uni[key[n == 1]] = freq[n == 1]
    bi[key[n == 2] >> 8, key[n == 2] & 255] = freq[n == 2]
    k, f = key[n == 3], freq[n == 3]
    i = np.argsort(k)
    return ByteLM(uni, bi, k[i], f[i], order)


def train_lm(docs: DataFrame, order: int = 3, text: str = "text") -> ByteLM:
    return load_lm(lm_counts(docs, max(2, order), text), order)


def bigram_model(counts: DataFrame) -> DataFrame:
    """``c, x, freq, context, log_cond, log_uni``: smoothed log probabilities of every observed pair."""
    uni = counts.where("n = 1").select(F.col("gram").alias("x"), F.col("freq").alias("x_freq"))
    total = uni.agg(F.sum("x_freq").alias("total"))
    bi = counts.where("n = 2").select(F.substring("gram", 1, 2).alias("c"), F.substring("gram", 3, 2).alias("x"), "freq")
    rows = bi.groupBy("c").agg(F.sum("freq").alias("context"))
    # tables of at most 256 rows
    d = bi.join(F.broadcast(rows), "c").join(F.broadcast(uni), "x").join(F.broadcast(total), F.lit(True))
    return d.select("c", "x", "freq", "context", F.log((F.col("freq") + 1) / (F.col("context") + 256)).alias("log_cond"), F.log((F.col("x_freq") + 1) / (F.col("total") + 256)).alias("log_uni"))


def _surprises(batches: Iterator[pa.RecordBatch], lm) -> Iterator[pa.RecordBatch]:
    """The surprise of the last byte of each gram, with the gram's count."""
    for b in batches:
        grams = [bytes.fromhex(g) for g in b.column(0).to_pylist()]
        if grams:
            h = np.array([lm.value.surprise(np.frombuffer(g, np.uint8))[-1] for g in grams], np.float32)
            value, group = np.unique(h, return_inverse=True)
            n = np.zeros(len(value), np.int64)
            np.add.at(n, group, b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["h", "n"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first two bytes of each text that has as many."""
    for b in batches:
        for data, lengths in flat(b.column(0)):
            at = (np.cumsum(lengths) - lengths)[lengths > 1]
            pair, n = np.unique(data[at].astype(np.int64) << 8 | data[at + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([f"{p:04X}" for p in pair.tolist()], pa.string()), pa.array(n.astype(np.int64))], ["gram", "freq"])


def surprise_histogram(docs: DataFrame, lm: ByteLM, text: str = "text") -> DataFrame:
    """``h, n``: how often each surprise value occurs. A value depends on at most three bytes, so grams are counted and each is scored once; percentiles stay exact."""
    shared = docs.sparkSession.sparkContext.broadcast(lm)
    grams = ngram_counts(docs, (min(3, max(2, lm.order)),), text).select("gram", "freq")
    if lm.order >= 3:
        heads = docs.select(to_bytes(text).alias("b")).mapInArrow(_heads, "gram string, freq long")
        grams = grams.union(heads.groupBy("gram").agg(F.sum("freq").alias("freq")))
    return grams.mapInArrow(partial(_surprises, lm=shared), "h float, n long").groupBy("h").agg(F.sum("n").alias("n"))


def surprise_stats(hist: DataFrame, percentile: float = 0.8) -> DataFrame:
    """One row: positions, mean, population deviation, p50, p80, p95, the boundary threshold, share of boundaries, mean token length."""
    h, n = F.col("h").cast("double"), F.col("n")
    s = hist.agg(
        F.sum(n).alias("positions"),
        (F.sum(h * n) / F.sum(n)).alias("mean"),
        (F.sum(h * h * n) / F.sum(n)).alias("__square"),
        *[F.percentile(h, F.lit(p), n).alias(name) for name, p in (("p50", 0.5), ("p80", 0.8), ("p95", 0.95), ("tau", percentile))],
    )
    over = hist.join(F.broadcast(s.select(F.col("tau").cast("float").alias("t"))), F.col("h") > F.col("t")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("boundaries"))
    d = s.join(F.broadcast(over), F.lit(True))
    share = F.col("boundaries") / F.col("positions")
    return d.select("positions", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("__square") - F.col("mean") * F.col("mean"))).alias("std"), "p50", "p80", "p95", "tau", share.alias("boundary_share"), (1 / (share + 1e-9)).alias("mean_length"))


def threshold(hist: DataFrame, percentile: float = 0.8) -> np.float32:
    """The percentile of the surprise, as the float32 that boundaries must exceed."""
    t = hist.agg(F.percentile(F.col("h").cast("double"), F.lit(percentile), F.col("n")).alias("t")).first()["t"]
    return np.float32(np.inf if t is None else t)
