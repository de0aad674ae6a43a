"""Exact substring dedup with suffix arrays.

Byte windows of fixed length that occur more than once are found by ``repeats``; text that
surely has no repeat is not sorted. Pieces of text that share a gram but differ somewhere
meet in one task, in shards. Each shard gets a suffix array by Larsson-Sadakane refinement
(groups of equal prefixes are split by the rank of the suffix that starts as far ahead as
the prefix is long, doubling it each time) and common prefixes in the manner of Kasai; a
group of pieces that goes on in the next shard is merged by binary search in the earlier
shards' arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.repeats import RESULT_NAMES, Spec, finish, hot_windows, keyed, meet, run_rows, split
from tokenmill.llm.texts import prepare
from tokenmill.scratch import drop_path, stage

SPEC = Spec(window=100, gram=20, words=False, strict=False)
#: Pieces of one shard, of at most 181 bytes each: its arrays then take some 40 MB.
SHARD_ROWS = 2_000


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a big-endian number; bytes behind the end are 0."""
    x = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    n, out = len(text), np.zeros(len(text), np.uint64)
    for j in range(8):
        out |= x[j : j + n] << np.uint64(56 - 8 * j)
    return out


def suffix_array(text: np.ndarray, depth: int | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least (all bytes by default).

    Larsson-Sadakane: start from groups of 8 equal bytes, then split only groups that are
    not single, by the rank of the suffix h bytes ahead, and double h.
    """
    n = len(text)
    words = words_at(text) if words is None else words
    # behind the end sorts first: shorter suffixes go before longer ones of the same bytes
    short = np.minimum(n - np.arange(n), 8)
    sa = np.lexsort((short, words)) if n and not text.all() else np.argsort(words, kind="stable")
    w, s = words[sa], short[sa]
    start = np.r_[True, (w[1:] != w[:-1]) | (s[1:] != s[:-1])] if n else np.zeros(0, bool)
    at = np.flatnonzero(start)
    size = np.diff(np.r_[at, n])
    rank = np.full(n + 1, -1, np.int64)
    rank[sa] = np.repeat(at, size)
    active = np.flatnonzero(np.repeat(size, size) > 1)
    h = 8
    while len(active) and h < (depth or n):
        p = sa[active]
        key = rank[p] * (n + 2) + rank[np.minimum(p + h, n)] + 1
        order = np.argsort(key, kind="stable")
        key, p = key[order], p[order]
        sa[active] = p
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[at, len(key)])
        rank[p] = np.repeat(active[at], size)
        active = active[np.repeat(size, size) > 1]
        h *= 2
    return sa


def _common(words: np.ndarray, n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at p and q share."""
    out = np.zeros(len(p), np.int64)
    i = np.arange(len(p))
    while len(i):
        a, b = p[i] + out[i], q[i] + out[i]
        inside = (a < n) & (b < n)
        i, a, b = i[inside], a[inside], b[inside]
        diff = words[a] ^ words[b]
        same = diff == 0
        end = i[~same]
        if len(end):
            x, k = diff[~same], np.zeros(len(end), np.int64)
            for j in range(1, 8):
                k += x >> np.uint64(64 - 8 * j) == 0
            out[end] += k
        i = i[same]
        out[i] += 8
    return np.minimum(out, n - np.maximum(p, q))


def common_prefixes(text: np.ndarray, sa: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Bytes that each suffix of the array shares with the one before it (the first: 0).

    Kasai: going through the text, a suffix whose neighbour is the neighbour before moved by
    one shares one byte less than the suffix before. Only where that chain breaks are bytes compared.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = words_at(text) if words is None else words
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    chain = np.r_[False, (phi[1:] == phi[:-1] + 1) & (phi[:-1] >= 0)]
    lcp = np.zeros(n, np.int64)
    head = np.flatnonzero(~chain & (phi >= 0))
    lcp[head] = _common(words, n, head, phi[head])
    i = np.arange(n)
    last = np.maximum.accumulate(np.where(chain, -1, i))
    lcp = np.where(chain, lcp[last] - (i - last), lcp)
    broken = np.flatnonzero(chain & (lcp <= 0))
    lcp[broken] = _common(words, n, broken, phi[broken])
    return lcp[sa]


class Shard:
    """A suffix array over the concatenated pieces of one shard."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        self.words = words_at(text)
        self.sa = suffix_array(text, depth, self.words)

    def equal_groups(self, at: np.ndarray) -> np.ndarray:
        """A number for each place of ``at``: equal where the ``depth`` bytes from there are equal."""
        seg = np.zeros(len(self.text), np.int64)
        seg[self.sa] = np.cumsum(common_prefixes(self.text, self.sa, self.words) < self.depth)
        return seg[at]

    def _below(self, other: Shard, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the window of this shard at p sorts before that of the other at ``at``; whether they are equal."""
        less, same, n = np.zeros(len(p), bool), np.ones(len(p), bool), len(self.text)
        for j in range(0, self.depth, 8):
            i = np.flatnonzero(same)
            if not len(i):
                break
            drop = np.uint64(8 * max(0, j + 8 - self.depth))
            a = np.where(p[i] + j < n, self.words[np.minimum(p[i] + j, n - 1)], np.uint64(0)) >> drop
            b = other.words[np.minimum(at[i] + j, len(other.text) - 1)] >> drop
            less[i] = a < b
            same[i] = a == b
        return less, same & (p + self.depth <= n)

    def has(self, other: Shard, at: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Whether windows of another shard are among the windows of this one that start at valid places: a binary search."""
        order = self.sa[valid[self.sa]]
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
        while len(i := np.flatnonzero(lo < hi)):
            mid = (lo[i] + hi[i]) // 2
            less, _ = self._below(other, at[i], order[mid])
            lo[i] = np.where(less, mid + 1, lo[i])
            hi[i] = np.where(less, hi[i], mid)
        found = np.zeros(len(at), bool)
        i = np.flatnonzero(lo < len(order))
        if len(i):
            found[i] = self._below(other, at[i], order[lo[i]])[1]
        return found


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of pieces that an earlier piece of the same gram has. Pieces come sorted by gram, sub, dk, tk and place; SHARD_ROWS of them are a shard."""
    depth, carried, last, before = SPEC.window, [], None, None
    for b in (whole.slice(a, SHARD_ROWS) for whole in batches for a in range(0, whole.num_rows, SHARD_ROWS)):
        names = ["h", "sub", "dk", "tk", "start"]
        place = [b.column(c).to_numpy() for c in names]
        again = np.logical_and.reduce([np.r_[before is not None and x[0] == before[i], x[1:] == x[:-1]] for i, x in enumerate(place)])
        before = [x[-1] for x in place]
        if again.any():  # the piece of a repeated row is the same piece
            b = b.filter(pa.array(~again))
            if not b.num_rows:
                continue
        h, sub, dk, tk, start = (b.column(c).to_numpy() for c in names)
        size = b.column("size").to_numpy()
        body = b.column("body")
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        text = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        group = np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (sub[1:] != sub[:-1])])
        piece = np.repeat(np.arange(len(h)), size)
        at = offsets[:-1][piece] + np.arange(len(piece)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
        shard = Shard(text, depth)
        seg = shard.equal_groups(at)
        order = np.lexsort((at, group[piece], seg))
        s, g = seg[order], group[piece][order]
        gone = np.zeros(len(at), bool)
        gone[order[1:]] = (s[1:] == s[:-1]) & (g[1:] == g[:-1])
        if carried and (h[0], sub[0]) == last:
            i = np.flatnonzero(group[piece] == 1)
            for one, valid in carried:
                gone[i] |= one.has(shard, at[i], valid)
        if not (carried and (h[0], sub[0]) == last and group[-1] == 1):
            carried = []
        last = (h[-1], sub[-1])
        valid = np.zeros(len(text), bool)
        valid[at[group[piece] == group[-1]]] = True
        carried.append((shard, valid))
        i = np.flatnonzero(gone)
        if not len(i):
            continue
        first = np.flatnonzero(np.r_[True, (piece[i][1:] != piece[i][:-1]) | (i[1:] != i[:-1] + 1)])
        count = np.diff(np.r_[first, len(i)])
        i = i[first]
        places = start[piece[i]] + at[i] - offsets[:-1][piece[i]]
        starts = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32)), pa.array(places.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(dk[piece[i]]), pa.array(tk[piece[i]]), starts, pa.array(count.astype(np.int32))], ["dk", "tk", "starts", "size"])


def suffix_dedup(docs: DataFrame, keep: bool = False, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, rest, n, n_removed, n_spans, kept_sha256, kept``, one row for each row of ``docs``.

    Texts are UTF-8 bytes (null: empty). A byte goes if a 100-byte string that covers it also
    starts earlier: in a smaller doc_id, or earlier in the same document; strings are judged on
    the input. ``kept`` has the remaining bytes if ``keep`` is set (null for a null text; a character that is cut
    in part goes whole), else null. Rows with a null doc_id come after all others; rows that share a doc_id are ordered by
    a hash of their text, and rows that repeat both are one document and get one result each.
    Empty and short texts lose nothing, an empty table gives no rows. ``rest`` is a struct of the columns named in ``carry``, as they are; others are ignored.
    """
    prepare(docs, "doc_id", "text")
    docs = keyed(docs, carry)
    met, met_path = stage(meet(run_rows(docs, SPEC), SPEC.strict), "sa-met")
    parts, _ = stage(split(docs, met, SPEC, keep), "sa-split", "kind")
    drop_path(docs.sparkSession, met_path)
    pieces = parts.where("kind = 1").select("h", "sub", "dk", "tk", "starts", "size", "body")
    sorted_pieces = pieces.select("h", "sub", "dk", "tk", F.col("starts")[0].alias("start"), "size", "body").repartition("h", "sub").sortWithinPartitions("h", "sub", "dk", "tk", "start")
    late = sorted_pieces.mapInArrow(_resolve, "dk long, tk int, starts array<int>, size int")
    hot = hot_windows(pieces, pieces.where("sub > 0").select("h").distinct(), SPEC)
    late = late if hot is None else late.union(hot)
    done = parts.where("kind = 0").select(*RESULT_NAMES)
    return done.union(finish(parts.where("kind = 2").select("doc_id", "dk", "tk", "text", "rest", "known"), late, SPEC, keep))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes cut from their texts; a character that is cut in part goes whole.

    A text that loses bytes and has no word left goes with its row; null and empty texts stay.
    Repeated rows of a doc_id and text are one document and stay as they are cut; see suffix_dedup
    for null doc_ids. An empty table gives none. Other columns pass through unchanged, whatever their names.
    """
    carry = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    found = suffix_dedup(docs, keep=True, carry=carry).withColumn("text", F.col("kept").cast("string"))
    found = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    of = lambda c: F.col("rest")[c] if c in carry else F.col(c).cast(docs.schema[c].dataType)
    return found.select(*[of(c).alias(c) for c in docs.columns])
