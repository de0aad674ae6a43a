"""Binary token files: shards, vocabularies and evaluation files.

All start with 256 little-endian 32-bit integers: a magic number, a version and counts.
Executors write through pyarrow's file systems; readers decode what Spark's binaryFile source
delivers, so any store that Spark reads will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Magic numbers, versions and the header's length, by format.
HEADER = 256
SHARD_16, SHARD_32 = (20240520, 1), (20240801, 7)
VOCAB_V1, VOCAB_V2 = (20240328, 1), (20240328, 2)
EVAL = (20240522, 1)
EVAL_DELIMITER = 65_535
V1_EOT = 50_256


def header(kind: tuple[int, int], *counts: int) -> bytes:
    return np.array([*kind, *counts, *[0] * (HEADER - 2 - len(counts))], "<i4").tobytes()


def _head(data: bytes) -> np.ndarray:
    if len(data) < 4 * HEADER:
        raise ValueError("the file is shorter than a header")
    return np.frombuffer(data, "<i4", HEADER)


def shard_bytes(tokens, vocab_size: int) -> bytes:
    """A shard: 16-bit tokens if the vocabulary fits, else 32-bit ones with their own magic number."""
    wide = vocab_size > 65_535
    if len(tokens) >= 2**31:
        raise ValueError("a shard has fewer than 2^31 tokens")
    return header(SHARD_32 if wide else SHARD_16, len(tokens)) + np.asarray(tokens).astype("<u4" if wide else "<u2").tobytes()


def shard_tokens(data: bytes) -> np.ndarray:
    """Tokens of a shard; the count must match the header."""
    h = _head(data)
    kind = (int(h[0]), int(h[1]))
    if kind not in (SHARD_16, SHARD_32):
        raise ValueError(f"not a token shard: {kind}")
    tokens = np.frombuffer(data, "<u2" if kind == SHARD_16 else "<u4", offset=4 * HEADER)
    if len(tokens) != h[2]:
        raise ValueError(f"the header says {h[2]} tokens, the file has {len(tokens)}")
    return tokens


def vocab_bytes(rows: list[tuple[int, bytes]], eot: int) -> bytes:
    """A vocabulary, version 2: for each id a length byte and the token; special tokens are literal."""
    if any(not 0 < len(t) < 256 for _, t in rows):
        raise ValueError("tokens are 1 to 255 bytes")
    return header(VOCAB_V2, len(rows), eot) + b"".join(struct.pack("B", len(t)) + t for _, t in sorted(rows))


def vocab_rows(data: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """Tokens and the end-of-text id of a vocabulary of either version; empty tokens stand for specials."""
    h = _head(data)
    kind = (int(h[0]), int(h[1]))
    if kind not in (VOCAB_V1, VOCAB_V2):
        raise ValueError(f"not a vocabulary: {kind}")
    at, rows = 4 * HEADER, []
    for i in range(int(h[2])):
        n = data[at]
        rows.append((i, data[at + 1 : at + 1 + n]))
        at += 1 + n
    return rows, int(h[3]) if kind == VOCAB_V2 else V1_EOT


def eval_bytes(examples: list[list[int]]) -> bytes:
    """An evaluation file of 16-bit streams (see ``choice.eval_stream``)."""
    longest = max((len(e) * 2 for e in examples), default=0)
    return header(EVAL, len(examples), longest) + b"".join(np.array(e, "<u2").tobytes() for e in examples)


def eval_examples(data: bytes) -> list[dict]:
    h = _head(data)
    if (int(h[0]), int(h[1])) != EVAL:
        raise ValueError("not an evaluation file")
    x, at, out = np.frombuffer(data, "<u2", offset=4 * HEADER).tolist(), 0, []
    for _ in range(int(h[2])):
        if x[at] != EVAL_DELIMITER:
            raise ValueError("an example has no delimiter")
        n, index, label, endings, context = x[at + 1 : at + 6]
        p = at + 6
        e = {"example_id": index, "label": label, "context": x[p : p + context], "endings": []}
        p += context
        for _ in range(endings):
            e["endings"].append(x[p + 1 : p + 1 + x[p]])
            p += 1 + x[p]
        if p != at + n // 2:
            raise ValueError("an example has another length than it says")
        out.append(e)
        at = p
    return out


def file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under another name and rename, so that a file is whole or absent."""
    f, p = file_system(uri)
    f.create_dir(p.rpartition("/")[0], recursive=True)
    t = TaskContext.get()
    part = f"{p}.part-{t.taskAttemptId() if t else 0}"
    with f.open_output_stream(part, compression=None) as out:
        out.write(data)
    f.move(part, p)


def _write(table: pa.Table, folder: str, name: str, vocab_size: int) -> pa.Table:
    table = table.sort_by("first").combine_chunks()
    shard, split = table.column("shard")[0].as_py(), table.column("split")[0].as_py()
    tokens = pc.list_flatten(table.column("tokens").combine_chunks()).to_numpy(zero_copy_only=False)
    path = f"{folder}/{name}_{split}_{shard:06d}.bin"
    write_file(path, shard_bytes(tokens, vocab_size))
    return pa.table({"path": [path], "shard": [shard], "n_tokens": pa.array([len(tokens)], pa.int64())})


def write_shards(packed: DataFrame, folder: str, vocab_size: int, name: str = "tokens") -> DataFrame:
    """Write packed pieces (see ``pack.pack``) as files, one task for each shard of bounded size; returns ``path, shard, n_tokens``."""
    write = partial(_write, folder=folder, name=name, vocab_size=vocab_size)
    return packed.select("shard", "split", "first", "tokens").groupBy("shard").applyInArrow(lambda t: write(t), "path string, shard long, n_tokens long")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            tokens = shard_tokens(content.as_py())
            for a in range(0, max(len(tokens), 1), 1 << 20):
                part = tokens[a : a + (1 << 20)]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array(part.astype(np.int64))], ["path", "pos", "token"])


def read_shards(spark: SparkSession, glob: str) -> DataFrame:
    """``path, pos, token`` of all shards of a glob."""
    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(_decode, "path string, pos long, token long")


def _peek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        heads = []
        for path in b.column("path").to_pylist():
            f, p = file_system(path)
            with f.open_input_stream(p, compression=None) as s:
                heads.append(_head(s.read(4 * HEADER)))
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([int(h[0]) for h in heads], pa.int32()), pa.array([int(h[1]) for h in heads], pa.int32()), pa.array([int(h[2]) for h in heads], pa.int64())], ["path", "magic", "version", "n_tokens"])


def peek_shards(spark: SparkSession, glob: str) -> DataFrame:
    """``path, magic, version, n_tokens`` from the headers alone."""
    return spark.read.format("binaryFile").load(glob).select("path").mapInArrow(_peek, "path string, magic int, version int, n_tokens long")


def sorted_shards(spark: SparkSession, glob: str) -> DataFrame:
    """``ordinal, path, n_tokens, before``: shard files in the order of their paths, with the tokens of those that stand before. One row for each file, no contents."""
    w = Window.orderBy("path")
    heads = peek_shards(spark, glob)
    return heads.select((F.row_number().over(w) - 1).cast("long").alias("ordinal"), "path", "n_tokens", F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"))


def missing(wanted: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key isn't written yet: what a repeated run has still to do."""
    return wanted.join(written.select(key), key, "left_anti")


def write_vocab(vocab: DataFrame, uri: str) -> None:
    rows = vocab.select("token_id", "token", "kind").collect()
    write_file(uri, vocab_bytes([(r["token_id"], bytes(r["token"])) for r in rows], next(r["token_id"] for r in rows if r["kind"] == "eot")))


def read_vocab(spark: SparkSession, uri: str) -> DataFrame:
    """``token_id, token, kind``."""
    data = bytes(spark.read.format("binaryFile").load(uri).select("content").first()["content"])
    rows, eot = vocab_rows(data)
    kind = lambda i, t: "eot" if i == eot else "byte" if len(t) == 1 and i < 256 else "pad" if t in (b"", b"<|pad|>") else "token"
    return spark.createDataFrame([(i, t, kind(i, t)) for i, t in rows], "token_id int, token binary, kind string")


def with_labels(df: DataFrame, letter: str) -> DataFrame:
    """``df`` with ``label``, the place of an answer letter in A, B, C, D."""
    return df.withColumn("label", F.instr(F.lit("ABCD"), F.col(letter)) - 1)
