"""Repeated windows over sequences of bytes or words, without a row for each window.

Each window of ``window`` units chooses one of its short grams, the one with the least
hash (the leftmost of equals). The choice depends on the window's content alone, so equal
windows choose equal grams at equal offsets. Neighbouring windows mostly choose the same
gram: such a *run* of windows is one row with its gram's hash and a digest of the text that
the whole run covers. Runs meet by gram hash. Runs of equal digest hold equal windows.
Runs of one gram and different digests may still share some windows; one run of each digest
is passed on as a *piece* of text, and the operators settle its windows by their own method.

Documents are known by ``dk``, their doc_id (null: after all others), and ``tk``, a hash of
their text that keeps rows of one doc_id apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tokenmill.llm.texts import byte_rows, word_blocks

LAST = (1 << 63) - 1
#: Runs of different digests of one gram that one task compares; more meet window by window.
SUB = 1 << 14
_CHUNK = 1 << 18
#: Bytes of output rows that a Python worker gathers.
_FLUSH = 2 << 20
#: Runs among which a worker settles repeats before they are shuffled.
_ROWS = 200_000
_U = np.uint64
_A, _B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class Spec(NamedTuple):
    """window, gram: in units; words: units are words, else bytes; strict: only windows of a smaller doc_id count as earlier."""

    window: int
    gram: int
    words: bool
    strict: bool


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@cache
def _byte_units() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=_U) * _U(_A))


def _sums(u: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, 1 << (max(len(u), 2 * _CHUNK) - 1).bit_length())
    out = np.zeros(len(u) + 1, _U)
    np.cumsum(u * up[: len(u)], out=out[1:])
    return out, down


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in one of the columns; the first row does."""
    out = np.ones(len(columns[0]), bool)
    np.not_equal(columns[0][1:], columns[0][:-1], out=out[1:])
    for c in columns[1:]:
        out[1:] |= c[1:] != c[:-1]
    return out


def _lengths(begin: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the stretches of n rows that begin at ``begin``."""
    out = np.empty(len(begin), np.int64)
    np.subtract(begin[1:], begin[:-1], out=out[:-1])
    out[-1:] = n - begin[-1:]
    return out


def runs(u: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, digest, first window and number of windows of each run of the units ``u``."""
    n, w = len(u) - spec.window + 1, spec.window - spec.gram + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, down = _sums(u, _A)
    g = _mix((p[spec.gram :] - p[: -spec.gram]) * down[: len(p) - spec.gram])
    # least hash of all 64 bits in each window, and its first place
    m, at = g, np.arange(len(g), dtype=np.int32)
    width = 1
    while width < w:
        step = min(width, w - width)
        left = m[:-step] <= m[step:]
        m, at = np.where(left, m[:-step], m[step:]), np.where(left, at[:-step], at[step:])
        width += step
    first = np.flatnonzero(_begins(at))
    size = _lengths(first, n)
    q, down = _sums(_mix(u), _B)
    digest = _mix((q[first + size - 1 + spec.window] - q[first]) * down[first] + size.astype(_U))
    return g[at[first]], digest, first, size


def chunks(data: bytes, spec: Spec) -> Iterator[tuple[int, np.ndarray]]:
    """Units of a text in parts of bounded size, each with the index of its first unit; every window is whole in one part."""
    over = spec.window - 1
    if not spec.words:
        for a in range(0, max(len(data) - over, 0), _CHUNK):
            yield a, _byte_units()[np.frombuffer(data, np.uint8, min(_CHUNK + over, len(data) - a), a)]
        return
    at, rest = 0, np.zeros(0, _U)
    for words in word_blocks(data):
        u = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
        u = np.concatenate([rest, u]) if len(rest) else u
        yield at, u
        rest = u[max(len(u) - over, 0) :]
        at += len(u) - len(rest)


def _lists(counts: np.ndarray, values: np.ndarray, null_empty: bool = False) -> pa.Array:
    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
    mask = pa.array(counts == 0) if null_empty else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)), mask=mask)


RUNS = "h long, digest long, dk long, tk int, at long, more array<int>"
_NAMES = ["h", "digest", "dk", "tk", "at", "more"]


def _later(h: np.ndarray, digest: np.ndarray, dk: np.ndarray, tk: np.ndarray, at: np.ndarray, strict: bool) -> np.ndarray:
    """Which runs repeat another one among these that comes earlier (strict: in a smaller dk); one that stands at the same place, of a repeated row, doesn't."""
    late = np.zeros(len(h), bool)
    z = h ^ (digest * _U(_B))
    order = np.argsort(z, kind="stable")
    same = z[order][1:] == z[order][:-1]
    some = order[np.r_[same, False] | np.r_[False, same]]
    if len(some):
        some = some[np.lexsort((at[some], tk[some], dk[some], digest[some], h[some]))]
        new = np.r_[True, (h[some][1:] != h[some][:-1]) | (digest[some][1:] != digest[some][:-1])]
        first = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        late[some] = dk[some] > dk[first] if strict else (dk[some] > dk[first]) | (tk[some] != tk[first]) | (at[some] != at[first])
    return late


def _run_rows(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    """A row for each different run of a text: at is first << 8 | windows, more has the first windows of its repeats in the text.

    Runs that repeat an earlier one of the rows gathered so far are settled here; they carry -at - 1.
    """

    def flush(parts):
        h, d, dk, tk, at, count = (np.concatenate([p[i] for p in parts]) for i in range(6))
        more = _lists(count, np.concatenate([p[6] for p in parts]), True)
        late = _later(h, d, dk, tk, at, spec.strict)
        # settled already: dealt evenly, so that a stretch of very many copies doesn't meet in one task
        h = np.where(late, _mix(dk.view(_U) * _U(_A) + at.view(_U)), h)
        at = np.where(late, -at - 1, at)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), pa.array(dk), pa.array(tk), pa.array(at), more], _NAMES)

    parts, held = [], 0
    for b in batches:
        dks, tks = b.column(0).to_numpy(), b.column(1).to_numpy()
        for i, data in enumerate(byte_rows(b.column(2))):
            for a, u in chunks(data or b"", spec):
                h, d, first, size = runs(u, spec)
                if not len(h):
                    continue
                order = np.lexsort((first, d, h))
                h, d, first, size = h[order], d[order], first[order] + a, size[order]
                new = np.flatnonzero(_begins(h, d))
                count = _lengths(new, len(h)) - 1
                again = np.ones(len(h), bool)
                again[new] = False
                k = len(new)
                parts.append((h[new], d[new], np.full(k, dks[i]), np.full(k, tks[i]), first[new] << 8 | size[new], count, first[again]))
                held += k
                if held > _ROWS:
                    yield flush(parts)
                    parts, held = [], 0
    if parts:
        yield flush(parts)


def keyed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, dk, tk, text, rest``; rest is a struct of the columns named in ``carry``, as they are."""
    rest = F.struct(*[F.col(f"`{c}`") for c in carry or []], F.lit(True).alias("__row"))
    return docs.select(rest.alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("dk"), F.hash(F.col("text").cast("string")).alias("tk"), F.col("text").cast("string").alias("text"))


def run_rows(docs: DataFrame, spec: Spec) -> DataFrame:
    return docs.select("dk", "tk", "text").mapInArrow(partial(_run_rows, spec=spec), RUNS)


MET = "kind int, h long, digest long, sub int, dk long, tk int, at long, starts array<int>"
DUP, PIECE, FIRST, MORE = 0, 1, 2, 3


def _meet(batches: Iterator[pa.RecordBatch], strict: bool, index: bool) -> Iterator[pa.RecordBatch]:
    """Settle runs that come sorted by gram hash, digest, dk, tk and at; a key of any size needs no more memory than one batch.

    DUP rows have windows that an earlier document (or, if not strict, an earlier place) has.
    PIECE rows are the first run of each digest where a gram has several digests; ``sub`` counts
    them in parts of SUB. For an index, there are FIRST rows instead, one for the first run of
    every digest, and MORE rows, for others of its document; their ``sub`` is 1 where the gram has
    several digests, else 0.
    """
    schema = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("digest", pa.int64()), ("sub", pa.int32()), ("dk", pa.int64()), ("tk", pa.int32()), ("at", pa.int64()), ("starts", pa.list_(pa.int32()))])

    def out(kind, rows, sub, first=True, more=True):
        n = rows.num_rows
        lists = rows.column("more")
        sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) if more else np.zeros(n, np.int64)
        at = rows.column("at").to_numpy()
        counts = sizes + first
        values = np.zeros(int(counts.sum()), np.int64)
        heads = np.zeros(len(values), bool)
        if first:
            heads[np.r_[0, np.cumsum(counts)][:-1].astype(np.int64)] = True
            values[heads] = at >> 8
        if more:
            values[~heads] = lists.flatten().to_numpy(zero_copy_only=False)
        # what is settled needs no hashes, which don't compress
        settled = isinstance(kind, int) and kind == DUP
        h, digest = [pa.array(np.zeros(n, np.int64))] * 2 if settled else (rows.column("h"), rows.column("digest"))
        cols = [pa.array(np.broadcast_to(np.int32(kind), n)), h, digest, pa.array(sub.astype(np.int32)), rows.column("dk"), rows.column("tk"), pa.array(at), _lists(counts, values)]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def release(held, several):
        """The first runs of a gram whose digests are known to be several, or not."""
        rows, new = held
        if index:
            yield out(np.where(new, FIRST, MORE), rows, np.full(len(new), several))
        elif several:
            yield out(PIECE, rows, np.zeros(len(new)), more=strict)

    held = None  # first runs of the gram's only digest so far, at the end of what has been read
    h0 = d0 = place0 = None
    seen = 0  # digests of that gram so far
    for b in batches:
        settled = b.column("at").to_numpy() < 0
        if settled.any():
            gone = b.filter(pa.array(settled))
            plain = pa.array(-gone.column("at").to_numpy() - 1)
            gone = pa.RecordBatch.from_arrays([plain if n == "at" else gone.column(n) for n in _NAMES], _NAMES)
            yield out(DUP, gone, np.zeros(gone.num_rows))
            b = b.filter(pa.array(~settled))
        if not b.num_rows:
            continue
        h, d, dk = (b.column(i).to_numpy() for i in range(3))
        new_h = np.r_[h0 is None or h[0] != h0, h[1:] != h[:-1]]
        new_d = new_h | np.r_[d0 is None or d[0] != d0, d[1:] != d[:-1]]
        i = np.arange(len(h))
        start = np.maximum.accumulate(np.where(new_d, i, -1))
        place = [dk, *([] if strict else (b.column(c).to_numpy() for c in ("tk", "at")))]
        least = [np.where(start >= 0, x[start], y) for x, y in zip(place, place0 or [0] * len(place), strict=True)]
        firsts = np.logical_and.reduce([x == y for x, y in zip(place, least, strict=True)])
        gram = np.cumsum(new_h)  # 0: goes on from before
        head = np.maximum.accumulate(np.where(new_h, i, -1))
        count = np.cumsum(new_d)
        ordinal = count - np.where(head >= 0, count[head] - 1, -seen)
        sub = (ordinal - 1) // SUB
        total = np.zeros(gram[-1] + 1, np.int64)
        np.maximum.at(total, gram, ordinal)
        multi = total[gram] > 1
        if held is not None and (gram[-1] > 0 or total[0] > 1):
            yield from release(held, gram[0] == 0 and total[0] > 1)
            held = None
        take = lambda m: b.filter(pa.array(m))  # noqa: B023, E731
        if (m := ~firsts).any():
            yield out(DUP, take(m), sub[m])
        if not strict and (m := firsts & b.column("more").is_valid().to_numpy(zero_copy_only=False)).any():
            yield out(DUP, take(m), sub[m], first=False)
        waits = firsts & ~multi & (gram == gram[-1])
        if index and (m := firsts & ~waits).any():
            yield out(np.where(new_d[m], FIRST, MORE), take(m), multi[m])
        if not index and (m := firsts & multi).any():
            yield out(PIECE, take(m), sub[m], more=strict)
        if waits.any():
            rest = [take(waits)] + ([held[0]] if held is not None else [])
            new = np.r_[new_d[waits], held[1] if held is not None else np.zeros(0, bool)]
            held = pa.Table.from_batches(rest).combine_chunks().to_batches()[0], new
        if gram[-1] > 0:
            seen = 0
        h0, d0, place0, seen = h[-1], d[-1], [x[-1] for x in least], int(ordinal[-1])
    if held is not None:
        yield from release(held, False)


def meet(rows: DataFrame, strict: bool, index: bool = False, parts: int | None = None) -> DataFrame:
    dealt = rows.repartition(parts, "h") if parts else rows.repartition("h")
    return dealt.sortWithinPartitions("h", "digest", "dk", "tk", "at").mapInArrow(partial(_meet, strict=strict, index=index), MET)


def units(data: bytes, spec: Spec):
    return data.split() if spec.words else np.frombuffer(data, np.uint8)


def mask_of(n: int, first: np.ndarray, size: np.ndarray, spec: Spec) -> np.ndarray:
    """Which of n units lie in windows, given by the first one of a stretch and their number."""
    edge = np.zeros(n + 1, np.int64)
    if len(first):
        np.add.at(edge, first, 1)
        np.add.at(edge, first.astype(np.int64) + size - 1 + spec.window, -1)
    return np.cumsum(edge[:-1]) > 0


def digest_of(data: bytes, first: np.ndarray, size: np.ndarray, spec: Spec, keep: bool) -> tuple[int, int, int, str, bytes | None]:
    """Units, removed units, removed runs, SHA-256 of what is kept, and (if ``keep``) what is kept, without characters that are cut in part."""
    x = units(data, spec)
    if len(first):
        gone = mask_of(len(x), first, size, spec)
        n_gone, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = b" ".join(compress(x, (~gone).tolist())) if spec.words else x[~gone].tobytes()
    else:
        n_gone, spans, kept = 0, 0, b" ".join(x) if spec.words else data
    rest = kept.decode("utf-8", "ignore").encode() if keep else None
    return len(x), n_gone, spans, hashlib.sha256(kept).hexdigest(), rest


_SPLIT = "kind int, doc_id long, dk long, tk int, text string, known array<int>, h long, sub int, starts array<int>, size int, body binary, n long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _with_rest(kinds: str, docs: DataFrame) -> StructType:
    return StructType([*StructType.fromDDL(kinds).fields, StructField("rest", docs.schema["rest"].dataType)])


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's values begin and end, and the values of all rows; a null list is empty."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64), lists.flatten()


def _split(batches: Iterator[pa.RecordBatch], spec: Spec, keep: bool) -> Iterator[pa.RecordBatch]:
    """Per document: its result if its runs are settled, else the document with what is known, and its pieces."""
    schema = pa.schema([(n, _KINDS[t]) for n, t in (x.rsplit(" ", 1) for x in _SPLIT.split(", "))])

    def rows_of(kind, n, columns, rest):
        all_columns = {"kind": pa.array(np.full(n, kind, np.int32)), **columns}
        return pa.RecordBatch.from_arrays([*(all_columns[f.name].cast(f.type) if f.name in all_columns else pa.nulls(n, f.type) for f in schema), rest], [*schema.names, "rest"])

    for b in batches:
        ends, found = _flat(b.column("found"))
        kind, h, sub, at, starts = found.flatten()
        kind, at = kind.to_numpy(), at.to_numpy()
        cuts, first = _flat(starts)
        first, size = first.to_numpy(), at & 255
        of_dup, of_size = np.repeat(kind == DUP, np.diff(cuts)), np.repeat(size, np.diff(cuts))
        doc_id, dk, tk, text, rests = (b.column(c) for c in ("doc_id", "dk", "tk", "text", "rest"))

        def flush(done, results, waiting, known, pieces, owner, bodies):
            if done:
                rows = pa.array(done)  # noqa: B023
                n, gone, spans, sha, kept = zip(*results, strict=True)
                kept = pa.array(kept, pa.binary())
                yield rows_of(0, len(done), {"doc_id": doc_id.take(rows), "n": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha), "kept": kept}, rests.take(rows))  # noqa: B023
            if waiting:
                rows, owners, open_runs = pa.array(waiting), pa.array(np.concatenate(owner)), np.concatenate(pieces)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, known)]).astype(np.int32)), pa.array(np.concatenate(known).astype(np.int32)))
                yield rows_of(2, len(waiting), {"doc_id": doc_id.take(rows), "dk": dk.take(rows), "tk": tk.take(rows), "text": text.take(rows), "known": lists}, rests.take(rows))  # noqa: B023
                take = pa.array(open_runs)
                yield rows_of(1, len(take), {"dk": dk.take(owners), "tk": tk.take(owners), "h": h.take(take), "sub": sub.take(take), "starts": starts.take(take), "size": pa.array(size[open_runs]), "body": pa.array(bodies, pa.binary())}, pa.nulls(len(take), rests.type))  # noqa: B023

        state, held = ([], [], [], [], [], [], []), 0
        for i, data in enumerate(byte_rows(text)):
            done, results, waiting, known, pieces, owner, bodies = state
            a, z = ends[i], ends[i + 1]
            dup = of_dup[cuts[a] : cuts[z]]
            places, sizes = first[cuts[a] : cuts[z]][dup], of_size[cuts[a] : cuts[z]][dup]
            own = a + np.flatnonzero(kind[a:z] != DUP)
            if not len(own):
                results.append(digest_of(data or b"", places, sizes, spec, keep and data is not None))
                done.append(i)
                held += 100 + len(results[-1][-1] or b"")
            else:
                x = units(data, spec) if spec.words else data
                for p in own.tolist():
                    f = int(at[p]) >> 8
                    part = x[f : f + int(size[p]) - 1 + spec.window]
                    bodies.append(b" ".join(part) if spec.words else part)
                    held += len(bodies[-1]) + 60
                pieces.append(own)
                owner.append(np.full(len(own), i))
                waiting.append(i)
                known.append(np.stack([places, sizes], 1).ravel())
                held += len(data)
            if held > _FLUSH:
                yield from flush(*state)
                state, held = ([], [], [], [], [], [], []), 0
        yield from flush(*state)


def split(docs: DataFrame, met: DataFrame, spec: Spec, keep: bool) -> DataFrame:
    """Join settled and open runs to their documents; kind 0: results, 1: pieces, 2: documents that wait for pieces."""
    found = met.groupBy("dk", "tk").agg(F.collect_set(F.struct("kind", "h", "sub", "at", "starts")).alias("found"))
    return docs.join(found, ["dk", "tk"], "left").select("doc_id", "dk", "tk", "text", "rest", "found").mapInArrow(partial(_split, spec=spec, keep=keep), _with_rest(_SPLIT, docs))


def _piece_windows(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            x = r["body"].split(b" ") if spec.words else r["body"]
            for j in range(r["size"]):
                w = hashlib.blake2b(b" ".join(x[j : j + spec.window]) if spec.words else x[j : j + spec.window], digest_size=16).digest()
                s = [a + j for a in r["starts"]]
                rows.append((int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True), r["dk"], r["tk"], s[0] << 8 | 1, s[1:] or None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())), strict=True)], _NAMES)


def hot_windows(pieces: DataFrame, hot: DataFrame, spec: Spec) -> DataFrame | None:
    """``dk, tk, starts, size`` from grams (``hot``) of more than SUB digests, whose windows meet one by one by a 128-bit digest; None if there is no such gram."""
    if not hot.limit(1).count():
        return None
    rows = pieces.join(hot, "h", "left_semi").select("h", "dk", "tk", "starts", "size", "body").mapInArrow(partial(_piece_windows, spec=spec), RUNS)
    return meet(rows, spec.strict).where(F.col("kind") == DUP).select("dk", "tk", "starts", F.lit(1).alias("size"))


RESULT = "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string, kept binary"
RESULT_NAMES = ["doc_id", "n", "n_removed", "n_spans", "kept_sha256", "kept", "rest"]


def _finish(batches: Iterator[pa.RecordBatch], spec: Spec, keep: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def flush(rows, rest):
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*cols, rest], RESULT_NAMES)

    for b in batches:
        rows, size, first, rests = [], 0, 0, b.column("rest")
        ends, known = _flat(b.column("known"))
        known = known.to_numpy()
        late_ends, late = _flat(b.column("late"))
        starts, sizes = late.flatten()
        cuts, starts = _flat(starts)
        starts, sizes = starts.to_numpy(), np.repeat(sizes.to_numpy(), np.diff(cuts))
        for i, data in enumerate(byte_rows(b.column("text"))):
            own, at = known[ends[i] : ends[i + 1]], slice(cuts[late_ends[i]], cuts[late_ends[i + 1]])
            rows.append((b.column("doc_id")[i].as_py(), *digest_of(data, np.concatenate([own[::2], starts[at]]), np.concatenate([own[1::2], sizes[at]]), spec, keep)))
            size += len(data) if keep else 200
            if size > _FLUSH or i + 1 == b.num_rows:
                yield flush(rows, rests.slice(first, len(rows)))
                rows, size, first = [], 0, i + 1


def finish(waiting: DataFrame, late: DataFrame, spec: Spec, keep: bool) -> DataFrame:
    """Results of documents that waited, with the windows (``dk, tk, starts, size``) that their pieces lose."""
    late = late.groupBy("dk", "tk").agg(F.collect_list(F.struct("starts", "size")).alias("late"))
    return waiting.join(late, ["dk", "tk"], "left").select("doc_id", "rest", "text", "known", "late").mapInArrow(partial(_finish, spec=spec, keep=keep), _with_rest(RESULT, waiting))
