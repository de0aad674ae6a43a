"""Exact byte n-gram counts.

Windows never cross documents. A task packs the windows of the largest size into integers, sorts
and counts them in numpy; sorted windows have their shorter prefixes in order too, so every other
size follows from the same counts. The shuffle carries one row for each different window of the
largest size of a task, dealt by the prefix of the smallest size, and the other sizes are derived
where equal prefixes have met.

The most frequent grams alone need less. A first scan counts the windows of each size by a hash
into a fixed number of buckets; a gram is never more frequent than its bucket. A second scan
counts the grams of the buckets that reach a threshold, exactly. If the k-th of these reaches it
as well, none of the others can be among the first k; else its frequency is the next threshold,
which is sure to be reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions.bytesx import to_bytes, windows

_BLOCK = 4 << 20  # bytes that are sorted at once
_HELD = 8 << 20  # different windows that a task holds before it passes them on
_OUT = 1 << 18  # rows of a batch
_EXACT = 4  # sizes below are counted where they are read: few values, whatever the text
_COUNTS = "n int, packed long, freq long"
_BITS = 18  # of a bucket's number
_PART = 1 << 14  # buckets that are summed up in one row
_SCAN = 1 << 20  # bytes that are hashed at once
_ODD = np.uint64(0x9E3779B97F4A7C15)


def flat(column: pa.Array, block: int = _BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of binary rows without copying, in parts of about ``block`` (a row is whole), and the lengths of the rows; null rows are empty."""
    if not len(column):
        return
    column = column.fill_null(b"") if column.null_count else column
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + block, "right")) - 1)
        yield data[ends[first] : ends[last]], np.diff(ends[first : last + 1])
        first = last


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), ">u8", padded, 0, (1,)).astype(np.uint64)


def packed(data: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Big-endian numbers of all windows of n bytes inside the rows."""
    return _split(data, lengths, n)[n]


def _split(data: np.ndarray, lengths: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """The windows of ``top`` bytes, and by their length the shorter ones that the ends of rows cut."""
    x = words_at(data)
    ends, whole, out = np.cumsum(lengths), np.ones(len(data), bool), {}
    for k in range(1, top):
        at = ends[lengths >= k] - k
        whole[at] = False
        out[k] = x[at] >> np.uint64(64 - 8 * k)
    out[top] = x[whole] >> np.uint64(64 - 8 * top)
    return out


def runs(values: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


class Counts:
    """Different values and how often each was added; merged as often as their number has doubled."""

    def __init__(self):
        self.parts, self.rows, self.least = [], 0, _BLOCK // 4

    def add(self, values: np.ndarray, freq: np.ndarray | None = None) -> None:
        if freq is None:
            values = np.sort(values)
            at = runs(values)
            values, freq = values[at], np.diff(np.r_[at, len(values)])
        if len(values):
            self.parts.append((values, freq))
            self.rows += len(values)
        if self.rows > self.least:
            self.least = max(_BLOCK // 4, 2 * len(self.merged()[0]))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """Values in ascending order, and their counts."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.parts) > 1:
            values, freq = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.argsort(values)
            values, freq = values[order], freq[order]
            at = runs(values)
            self.parts = [(values[at], np.add.reduceat(freq, at))]
            self.rows = len(at)
        return self.parts[0]


def shortened(values: np.ndarray, freq: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the prefixes of ascending windows, ``by`` bytes shorter."""
    values = values >> np.uint64(8 * by)
    at = runs(values)
    return (values[at], np.add.reduceat(freq, at)) if len(at) else (values, freq)


def _batches(n: int, values: np.ndarray, freq: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(values), _OUT):
        v = values[a : a + _OUT]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), n, np.int32)), pa.array(v.view(np.int64)), pa.array(freq[a : a + _OUT].astype(np.int64))], ["n", "packed", "freq"])


def _every_size(held: dict[int, Counts], sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, grams and counts, once for each size, from windows by length: those of n bytes or more have a gram of n bytes each."""
    top = max(held, default=0)
    values, freq = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for n in range(top, 0, -1):
        values, freq = shortened(values, freq, 1)
        if n in held:
            both = Counts()
            both.add(values, freq)
            both.add(*held[n].merged())
            values, freq = both.merged()
        if n in sizes and len(values):
            yield n, values, freq


def _windows(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], exact: int) -> Iterator[pa.RecordBatch]:
    """Counts of sizes below ``exact``; and windows of ``exact`` bytes or more, each of which stands for all its prefixes of the other sizes."""
    top, least = max(sizes), min([n for n in sizes if n >= exact], default=9)
    small = tuple(n for n in sizes if n < exact)

    def flush(held: dict[int, Counts]) -> Iterator[pa.RecordBatch]:
        for n, values, freq in _every_size(held, small) if small else ():
            yield from _batches(n, values, freq)
        for m in range(least, top + 1):
            if m in held:
                yield from _batches(m, *held[m].merged())

    held: dict[int, Counts] = {}
    for b in batches:
        for data, lengths in flat(b.column(0)):
            for m, values in _split(data, lengths, top).items():
                held.setdefault(m, Counts()).add(values)
            if sum(c.rows for c in held.values()) > _HELD and sum(len(c.merged()[0]) for c in held.values()) > _HELD:
                yield from flush(held)
                held = {}
    yield from flush(held)


def _derived(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], exact: int) -> Iterator[pa.RecordBatch]:
    """Final counts of every size from a partition that has all windows of its prefixes: it holds the different ones."""
    held: dict[int, Counts] = {}
    for b in batches:
        n, values, freq = (b.column(i).to_numpy() for i in range(3))
        for m in np.unique(n).tolist():
            at = n == m
            held.setdefault(m, Counts()).add(*_ascending(values[at].view(np.uint64), freq[at]))
    for m in [m for m in held if m < exact]:
        yield from _batches(m, *held.pop(m).merged())
    for n, values, freq in _every_size(held, tuple(n for n in sizes if n >= exact)):
        yield from _batches(n, values, freq)


def _ascending(values: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    values, freq = values[order], freq[order]
    at = runs(values)
    return values[at], np.add.reduceat(freq, at)


def _checked(sizes: tuple[int, ...]) -> tuple[int, ...]:
    if not sizes or min(sizes) < 1 or max(sizes) > 8:
        raise ValueError("n-gram sizes are 1 to 8")
    return tuple(sorted(set(sizes)))


def _hex_grams(counts: DataFrame) -> DataFrame:
    return counts.select("n", F.substring(F.lpad(F.hex("packed"), 16, "0"), 17 - F.col("n") * 2, F.col("n") * 2).alias("gram"), "freq")


def ngram_counts(docs: DataFrame, sizes: tuple[int, ...] = tuple(range(2, 9)), text: str = "text") -> DataFrame:
    """``n, gram, freq``; gram as upper-case hex. Sizes are 1 to 8 bytes; null texts count nothing."""
    sizes = _checked(sizes)
    rows = docs.select(to_bytes(text).alias("b")).mapInArrow(partial(_windows, sizes=sizes, exact=_EXACT), _COUNTS)
    least = min([n for n in sizes if n >= _EXACT], default=0)
    if least:
        prefix = F.expr(f"IF(n > {least}, shiftrightunsigned(packed, 8 * (n - {least})), packed)")
        found = rows.repartition(prefix).mapInArrow(partial(_derived, sizes=sizes, exact=_EXACT), _COUNTS)
    else:
        found = rows.groupBy("n", "packed").agg(F.sum("freq").alias("freq"))
    return _hex_grams(found)


def _bucket(x: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n bytes that begin each big-endian number; up to 2 bytes are their own bucket."""
    if n <= 2:
        return (x >> np.uint64(64 - 8 * n)).view(np.int64)
    h = (x >> np.uint64(64 - 8 * n)) * _ODD
    h >>= np.uint64(64 - bits)
    return h.view(np.int64)


def _n_buckets(n: int, bits: int) -> int:
    return 1 << (8 * n if n <= 2 else bits)


def _hashed(column: pa.Array, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows and each size: the 8 bytes from each place on, their buckets, and the places where no window of the size begins."""
    for data, lengths in flat(column, _SCAN):
        x, ends = words_at(data), np.cumsum(lengths)
        cut = [ends[lengths >= k] - k for k in range(1, max(sizes))]
        for n in sizes:
            yield n, x, _bucket(x, n, bits), np.concatenate([np.zeros(0, np.int64), *cut[: n - 1]])


def _bucket_rows(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for n, t in totals.items():
        for i in range(0, len(t), _PART):
            part = t[i : i + _PART]
            small = part.astype(np.min_scalar_type(int(part.max())))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([i], pa.int32()), pa.array([small.itemsize], pa.int32()), pa.array([small.tobytes()], pa.binary())], ["n", "first", "width", "totals"])


def _bucketed(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], bits: int) -> Iterator[pa.RecordBatch]:
    """Windows in each bucket, as numbers of the fewest bytes that hold them."""
    totals = {n: np.zeros(_n_buckets(n, bits), np.int64) for n in sizes}
    for b in batches:
        for n, _, h, cut in _hashed(b.column(0), sizes, bits):
            totals[n] += np.bincount(h, minlength=len(totals[n]))
            totals[n] -= np.bincount(h[cut], minlength=len(totals[n]))
    yield from _bucket_rows(totals)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for n, first, width, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            part = np.frombuffer(data, f"<u{width}").astype(np.int64)
            out[n, first] = out[n, first] + part if (n, first) in out else part
    for (n, first), part in out.items():
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([first], pa.int32()), pa.array([8], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["n", "first", "width", "totals"])


def bucket_totals(docs: DataFrame, sizes: tuple[int, ...], text: str = "text", bits: int = _BITS) -> dict[int, np.ndarray]:
    """Windows in each bucket, by size: at most 2 MB a size on the driver, whatever the table."""
    schema = "n int, first int, width int, totals binary"
    rows = docs.select(to_bytes(text).alias("b")).mapInArrow(partial(_bucketed, sizes=sizes, bits=bits), schema)
    out = {n: np.zeros(_n_buckets(n, bits), np.int64) for n in sizes}
    for r in rows.repartition("n", "first").mapInArrow(_summed, schema).collect():
        part = np.frombuffer(r["totals"], np.int64)
        out[r["n"]][r["first"] : r["first"] + len(part)] = part
    return out


def _within(batches: Iterator[pa.RecordBatch], masks: dict[int, bytes], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of the marked buckets. One gram of each bucket is counted by the bucket's number, others by sorting."""
    sizes = tuple(masks)
    marked = {n: np.unpackbits(np.frombuffer(m, np.uint8), count=_n_buckets(n, bits)).astype(bool) for n, m in masks.items()}
    slot = {n: (np.cumsum(m) - 1).astype(np.int32) for n, m in marked.items()}
    known = {n: np.zeros(int(m.sum()), bool) for n, m in marked.items()}
    gram = {n: np.zeros(len(m), np.uint64) for n, m in known.items()}
    freq = {n: np.zeros(len(m), np.int64) for n, m in known.items()}
    held: dict[int, Counts] = {n: Counts() for n in sizes}
    for b in batches:
        for n, x, h, cut in _hashed(b.column(0), sizes, bits):
            at = marked[n][h]
            at[cut] = False
            at = np.flatnonzero(at)
            values, place = x[at] >> np.uint64(64 - 8 * n), slot[n][h[at]]
            if not known[n].all():
                new = ~known[n][place]
                gram[n][place[new]] = values[new]
                known[n][place[new]] = True
            other = np.flatnonzero(gram[n][place] != values)
            freq[n] += np.bincount(place, minlength=len(freq[n]))
            freq[n] -= np.bincount(place[other], minlength=len(freq[n]))
            held[n].add(values[other])
            if sum(c.rows for c in held.values()) > _HELD and sum(len(c.merged()[0]) for c in held.values()) > _HELD:
                for m in sizes:
                    yield from _batches(m, *held[m].merged())
                held = {m: Counts() for m in sizes}
    for n in sizes:
        at = freq[n] > 0
        yield from _batches(n, gram[n][at], freq[n][at])
        yield from _batches(n, *held[n].merged())


def frequent_counts(docs: DataFrame, totals: dict[int, np.ndarray], least: dict[int, int], text: str = "text", bits: int = _BITS) -> DataFrame:
    """``n, gram, freq`` of every gram that is as frequent as its size's ``least``, from the buckets that are."""
    if all(t <= 1 for t in least.values()):
        return ngram_counts(docs, tuple(least), text)
    masks = {n: np.packbits(totals[n] >= t).tobytes() for n, t in least.items() if n > 2}
    own = [(n, int(i), int(totals[n][i])) for n, t in least.items() if n <= 2 for i in np.flatnonzero(totals[n] >= t)]
    rows = docs.sparkSession.createDataFrame(own, _COUNTS)
    if masks:
        rows = rows.union(docs.select(to_bytes(text).alias("b")).mapInArrow(partial(_within, masks=masks, bits=bits), _COUNTS))
    floor = F.element_at(F.create_map(*[F.lit(x).cast("long") for n, t in least.items() for x in (n, t)]), F.col("n").cast("long"))
    return _hex_grams(rows.groupBy("n", "packed").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= floor))


def _threshold(totals: np.ndarray, k: int) -> int:
    """A frequency that somewhat more than k buckets reach."""
    at = k + k // 4 + 16
    return max(1, int(np.partition(totals, len(totals) - at)[len(totals) - at])) if at <= len(totals) else 1


def most_frequent(docs: DataFrame, k: int, sizes: tuple[int, ...], text: str = "text", bits: int = _BITS) -> DataFrame:
    """``n, gram, freq``: what ``top_grams`` takes from all counts, without counting all grams."""
    sizes = _checked(sizes)
    totals = bucket_totals(docs, sizes, text, bits)
    least = _threshold(np.concatenate(list(totals.values())), k)
    while True:
        rows = top_grams(frequent_counts(docs, totals, dict.fromkeys(sizes, least), text, bits), k).collect()
        if least <= 1 or (len(rows) == k and min([r["freq"] for r in rows], default=least) >= least):
            return docs.sparkSession.createDataFrame(rows, "n int, gram string, freq long")
        least = min([r["freq"] for r in rows]) if len(rows) == k else 1


def most_frequent_per_size(docs: DataFrame, k: int, sizes: tuple[int, ...], text: str = "text", bits: int = _BITS) -> DataFrame:
    """``n, gram, freq, rank``: what ``top_per_size`` takes from all counts, without counting all grams."""
    sizes = _checked(sizes)
    totals = bucket_totals(docs, sizes, text, bits)
    least, done = {n: _threshold(totals[n], k) for n in sizes}, []
    while least:
        rows = top_per_size(frequent_counts(docs, totals, least, text, bits), k).collect()
        after = {}
        for n, t in least.items():
            own = [r for r in rows if r["n"] == n]
            last = min([r["freq"] for r in own], default=1) if len(own) == k else 1
            if last >= t:
                done += own
            else:
                after[n] = last
        least = after
    return docs.sparkSession.createDataFrame(done, "n int, gram string, freq long, rank int")


def _count_by(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = b.column(0).dictionary_encode()
        group, values = codes.indices.fill_null(-1).to_numpy(), codes.dictionary.to_pylist()
        for g in np.unique(group):
            rows = b.column(1).filter(pa.array(group == g))
            for part in _windows(iter([pa.RecordBatch.from_arrays([rows], ["b"])]), sizes, 9):
                yield pa.RecordBatch.from_arrays([pa.array([None if g < 0 else values[g]] * part.num_rows, pa.string()), *part.columns], ["grp", *part.schema.names])


def ngram_counts_by(docs: DataFrame, by: str, sizes: tuple[int, ...], text: str = "text") -> DataFrame:
    """``<by>, n, gram, freq``: counts for each value of a string column, from one scan."""
    rows = docs.select(F.col(by).cast("string").alias("grp"), to_bytes(text).alias("b")).mapInArrow(partial(_count_by, sizes=tuple(sizes)), "grp string, n int, packed long, freq long")
    found = rows.groupBy("grp", "n", "packed").agg(F.sum("freq").alias("freq"))
    return found.select(F.col("grp").alias(by), "n", F.substring(F.lpad(F.hex("packed"), 16, "0"), 17 - F.col("n") * 2, F.col("n") * 2).alias("gram"), "freq")


def ngram_counts_sql(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """The same counts for one size, in built-in functions only; grams may be of any length."""
    grams = docs.select(F.explode(windows(to_bytes(text), n)).alias("gram"))
    return grams.groupBy("gram").count().select(F.lit(n).alias("n"), F.hex("gram").alias("gram"), F.col("count").alias("freq"))


def ngram_totals(counts: DataFrame) -> DataFrame:
    """``n, windows, distinct_grams``."""
    return counts.groupBy("n").agg(F.sum("freq").alias("windows"), F.count("*").alias("distinct_grams"))


def top_per_size(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent grams of each size; ties by bytes."""
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("freq"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def top_grams(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent grams; ties to the shorter, then by bytes."""
    return counts.orderBy(F.desc("freq"), "n", "gram").limit(k)
