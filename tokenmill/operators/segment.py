"""Segments between surprising bytes, and counts of segments and of adjacent pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.bytesx import to_bytes
from tokenmill.operators.bytelm import ByteLM
from tokenmill.operators.ngrams import Counts, flat, runs, words_at

_FLUSH = 200_000
_HELD = 4 << 20  # different tokens, or longer ones, that a task holds before it passes them on


def segments(data: bytes, lm: ByteLM, tau: np.float32) -> list[bytes]:
    """Cut before every byte whose surprise exceeds ``tau``."""
    if not data:
        return []
    starts = np.flatnonzero(lm.surprise(np.frombuffer(data, np.uint8)) > tau) + 1
    edges = [0, *starts.tolist(), len(data)]
    return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def chopped(data: bytes, lm: ByteLM, tau: np.float32, max_len: int) -> Iterator[bytes]:
    for s in segments(data, lm, tau):
        for a in range(0, len(s), max_len):
            yield s[a : a + max_len]


def _counted(batches: Iterator[pa.RecordBatch], lm, tau, max_len: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        rows = list(counts.items())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows], pa.int32()), pa.array([t for (_, t), _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], ["pair", "token", "freq"])

    for b in batches:
        for x in b.column(0):
            data = x.as_py() or b""
            if not pairs:
                counts.update((0, t) for t in chopped(data, lm.value, tau, max_len))
            else:
                found = segments(data, lm.value, tau)
                counts.update((0, t) for t in found if 2 <= len(t) <= max_len)
                counts.update((1, p + t) for p, t in zip(found, found[1:], strict=False) if 2 <= len(p) + len(t) <= max_len)
            if len(counts) > _FLUSH:
                yield flush()
    if counts:
        yield flush()


def _starts(data: np.ndarray, lengths: np.ndarray, tables: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """Where segments begin in rows that stand one behind the other."""
    begins = (np.cumsum(lengths) - lengths)[lengths > 0]
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        key = data[:-1].astype(np.int32) << 8 | data[1:]
        if order >= 3:
            cut[2:] = tables[0][key[:-1] << 8 | data[2:]]
            second = (begins + 1)[lengths[lengths > 0] > 1]
            cut[second] = tables[1][key[second - 1]]
        else:
            cut[1:] = tables[1][key]
    cut[begins] = True
    return np.flatnonzero(cut)


class _Tokens:
    """Counts of tokens of up to 16 bytes, by kind and length: up to 8 bytes as one number; longer ones as two, counted in stretches."""

    def __init__(self):
        self.short, self.long, self.rows = {}, {}, 0

    def add(self, pair: int, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        for n in range(1, 9):
            at = starts[sizes == n]
            if len(at):
                self.short.setdefault((pair, n), Counts()).add(x[at] >> np.uint64(64 - 8 * n))
        for n in range(9, 17):
            at = starts[sizes == n]
            if len(at):
                self.long.setdefault((pair, n), []).append((x[at], x[at + 8] >> np.uint64(128 - 8 * n)))
                self.rows += len(at)

    def held(self) -> int:
        return self.rows + sum(c.rows for c in self.short.values())

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (pair, n), c in self.short.items():
            values, freq = c.merged()
            yield from _binary(pair, n, [(values << np.uint64(64 - 8 * n), n)], freq)
        for (pair, n), parts in self.long.items():
            high, low = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            at = np.union1d(runs(high), runs(low))
            yield from _binary(pair, n, [(high[at], 8), (low[at] << np.uint64(128 - 8 * n), n - 8)], np.diff(np.r_[at, len(high)]))
        self.__init__()


def _binary(pair: int, n: int, words: list[tuple[np.ndarray, int]], freq: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of tokens of ``n`` bytes, from the first bytes of big-endian numbers."""
    for a in range(0, len(freq), _FLUSH):
        data = np.concatenate([w[a : a + _FLUSH].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :k] for w, k in words], axis=1)
        offsets = np.arange(len(data) + 1, dtype=np.int32) * n
        token = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), pair, np.int32)), token, pa.array(freq[a : a + _FLUSH].astype(np.int64))], ["pair", "token", "freq"])


def _packed(batches: Iterator[pa.RecordBatch], lm, tau, max_len: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    """The counts of ``_counted`` for tokens of up to 16 bytes, without an object for each."""
    tables, order, found = lm.value.surprising(tau), lm.value.order, _Tokens()
    for b in batches:
        for data, lengths in flat(b.column(0)):
            if not len(data):
                continue
            starts = _starts(data, lengths, tables, order)
            sizes = np.diff(np.r_[starts, len(data)])
            x = np.concatenate([words_at(data), np.zeros(8, np.uint64)])
            if pairs:
                keep = (sizes >= 2) & (sizes <= max_len)
                found.add(0, x, starts[keep], sizes[keep])
                first = np.zeros(len(data), bool)
                first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
                both = sizes[:-1] + sizes[1:]
                keep = ~first[starts[1:]] & (both <= max_len)
                found.add(1, x, starts[:-1][keep], both[keep])
            else:
                pieces = -(-sizes // max_len)
                k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                found.add(0, x, np.repeat(starts, pieces) + k * max_len, np.minimum(np.repeat(sizes, pieces) - k * max_len, max_len))
        if found.held() > _HELD:
            yield from found.flush()
    yield from found.flush()


def _rows(docs: DataFrame, lm: ByteLM, tau: np.float32, max_len: int, pairs: bool, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lm)
    return docs.select(to_bytes(text).alias("b")).mapInArrow(partial(_packed if max_len <= 16 else _counted, lm=shared, tau=tau, max_len=max_len, pairs=pairs), "pair int, token binary, freq long")


def segment_counts(docs: DataFrame, lm: ByteLM, tau: np.float32, max_len: int = 16, text: str = "text") -> DataFrame:
    """``token, freq`` of all segments; a longer one is chopped from its start, and its rest is kept."""
    return _rows(docs, lm, tau, max_len, False, text).groupBy("token").agg(F.sum("freq").alias("freq"))


def segment_pair_counts(docs: DataFrame, lm: ByteLM, tau: np.float32, max_len: int = 16, text: str = "text") -> DataFrame:
    """``token, freq`` of segments and adjacent pairs of 2 to ``max_len`` bytes, longer ones dropped; a token that is both has the larger count."""
    each = _rows(docs, lm, tau, max_len, True, text).groupBy("pair", "token").agg(F.sum("freq").alias("freq"))
    return each.groupBy("token").agg(F.max("freq").alias("freq"))


def token_pmi(tokens: DataFrame, model: DataFrame) -> DataFrame:
    """``tokens`` with ``pmi``, by a join of each token's adjacent bytes with the pair model (at most 65,536 rows)."""
    hexed = F.hex("token")
    places = F.sequence(F.lit(0), F.octet_length("token") - 2)
    pairs = tokens.where(F.octet_length("token") >= 2).select("token", F.explode(F.transform(places, lambda i: F.struct(F.substring(hexed, i * 2 + 1, F.lit(2)).alias("c"), F.substring(hexed, i * 2 + 3, F.lit(2)).alias("x")))).alias("p"))
    scored = pairs.select("token", "p.c", "p.x").join(F.broadcast(model), ["c", "x"], "left")
    found = scored.groupBy("token").agg(F.sum(F.col("log_cond") - F.col("log_uni")).alias("pmi"))
    return tokens.join(found, "token", "left")
