"""Encoding by greedy longest match, decoding, and the tokenizer protocol."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import partial
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.bytesx import to_bytes


@runtime_checkable
class TokenizerLike(Protocol):
    """What the metrics need of a tokenizer."""

    n_vocab: int
    eot_token: int

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> bytes: ...


_TRIE = 4_096


def _pattern(tokens: Iterable[bytes]) -> bytes:
    """A pattern that matches the longest of the tokens, or one byte: a trie, in which the branches of a node come before its own end."""
    root: dict = {}
    for t in tokens:
        at = root
        for x in t:
            at = at.setdefault(x, {})
        at[None] = True

    def of(node: dict) -> bytes:
        branches = [re.escape(bytes([x])) + of(below) for x, below in sorted((x, n) for x, n in node.items() if x is not None)]
        if not branches:
            return b""
        return b"(?:" + b"|".join(branches) + b")" + (b"?" if None in node else b"")

    found = of(root)
    return found + b"|." if found else b"."


class GreedyTokenizer:
    """Longest match from left to right over UTF-8 bytes. Special tokens never match, so decoding always gives the text back."""

    def __init__(self, rows: list[tuple[int, bytes, str]]):
        self.tokens = {i: (t, kind) for i, t, kind in rows}
        self.n_vocab = len(rows)
        self.eot_token = next(i for i, _, kind in rows if kind == "eot")
        self.ids = {t: i for i, t, kind in rows if kind == "token"}
        longest: dict[bytes, set[int]] = {}
        for t in self.ids:
            longest.setdefault(t[:2], set()).add(len(t))
        #: Lengths to try, longest first, for each pair of first bytes.
        self.lengths = {k: sorted(v, reverse=True) for k, v in longest.items()}

        #: Patterns of the longest match, for vocabularies that compile to a short program.
        self._trie = _pattern(self.ids) if len(self.ids) <= _TRIE and max(map(len, self.ids), default=0) <= 64 else None
        self._find = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_find": None}

    def encode_bytes(self, data: bytes) -> list[int]:
        if self._trie is not None:
            if self._find is None:
                self._find, self._id = re.compile(self._trie, re.DOTALL).findall, {bytes([i]): i for i in range(256)} | self.ids
            return list(map(self._id.__getitem__, self._find(data)))
        return self.walk(data)

    def walk(self, data: bytes) -> list[int]:
        """The same, place by place, for vocabularies of any size."""
        out, i, n = [], 0, len(data)
        ids, lengths = self.ids, self.lengths
        while i < n:
            for size in lengths.get(data[i : i + 2], ()):
                t = ids.get(data[i : i + size])
                if t is not None and i + size <= n:
                    out.append(t)
                    i += size
                    break
            else:
                out.append(data[i])
                i += 1
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_bytes(text.encode("utf-8", "replace"))

    def encode_with_eot(self, text: str) -> list[int]:
        return [self.eot_token, *self.encode(text)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i][0] for i in ids if i in self.tokens and self.tokens[i][1] in ("byte", "token"))

    def decode_str(self, ids: list[int]) -> str:
        return self.decode(ids).decode("utf-8", "replace")


def load_tokenizer(vocab: DataFrame) -> GreedyTokenizer:
    """A tokenizer on the driver, from a vocabulary table of ``vocab_size`` rows."""
    return GreedyTokenizer([(r["token_id"], bytes(r["token"]), r["kind"]) for r in vocab.select("token_id", "token", "kind").orderBy("token_id").collect()])


_ENCODED = 1 << 20  # tokens of a batch of encoded or decoded rows, but for a row that has more


def _encode(batches: Iterator[pa.RecordBatch], tokenizer, eot: bool) -> Iterator[pa.RecordBatch]:
    t = tokenizer.value
    head = array("i", [t.eot_token] if eot else [])
    plain = isinstance(t, GreedyTokenizer)
    for b in batches:
        # as flat buffers of a stretch of rows: a row is a slice of one
        texts, first = b.column(b.num_columns - 1), 0
        ids, offsets = array("i"), [0]
        for k in range(b.num_rows):
            data = texts[k].as_py() or b""
            ids += head
            ids.extend(t.encode_bytes(data) if plain else t.encode(data.decode("utf-8", "replace")))
            offsets.append(len(ids))
            if len(ids) >= _ENCODED or k == b.num_rows - 1:
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
                part = b.slice(first, k + 1 - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], part.column(b.num_columns - 1).is_valid(), lists], [*b.schema.names[:-1], "__ok", "tokens"])
                first, ids, offsets = k + 1, array("i"), [0]


def encode(df: DataFrame, tokenizer: TokenizerLike, text: str = "text", eot: bool = False) -> DataFrame:
    """``df`` without its text, with ``tokens``; one pass and no shuffle. A null text has null tokens."""
    rest = [c for c in df.columns if c != text]
    kinds = "".join(f"`{n}` {k}, " for n, k in df.dtypes if n in rest)
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    out = df.select(*rest, to_bytes(text).alias("__bytes")).mapInArrow(partial(_encode, tokenizer=shared, eot=eot), f"{kinds}__ok boolean, tokens array<int>")
    return out.withColumn("tokens", F.when(F.col("__ok"), F.col("tokens"))).drop("__ok")


def token_rows(encoded: DataFrame, key: str) -> DataFrame:
    """``key, pos, token_id``: one row for each token, pos from 0."""
    return encoded.select(key, F.posexplode("tokens").alias("pos", "token_id"))


def decode_rows(rows: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """``key, data``: bytes of each key's tokens in order, from one row for each token. Ids out of range and special tokens give nothing; the vocabulary is broadcast (its size is a parameter)."""
    v = F.broadcast(vocab.where(F.col("kind").isin("byte", "token")).select("token_id", F.hex("token").alias("hexed")))
    parts = rows.join(v, "token_id").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "hexed"))).alias("parts"))
    return parts.select(key, F.unhex(F.array_join(F.transform("parts", lambda p: p["hexed"]), "")).alias("data"))


_DECODED = 1 << 26  # bytes of a batch of decoded rows


def _decode(batches: Iterator[pa.RecordBatch], tokens) -> Iterator[pa.RecordBatch]:
    """The last column, lists of ids, as their bytes: the tokens of a stretch of rows are taken at once, and a row is a stretch of their buffer."""
    table = pa.array(tokens.value, pa.large_binary())  # ends with an empty token for unknown ids
    sizes = np.diff(np.frombuffer(table.buffers()[1], np.int64, len(table) + 1))
    for whole in batches:
        rows = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(whole.column(whole.num_columns - 1)).fill_null(0), np.int64))]
        begin = 0
        while begin < whole.num_rows:
            end = max(begin + 1, int(np.searchsorted(rows, rows[begin] + _ENCODED, "right")) - 1)
            b, ends = whole.slice(begin, end - begin), rows[begin : end + 1] - rows[begin]
            begin = end
            lists = b.column(b.num_columns - 1)
            ids = np.array(lists.flatten().fill_null(-1), np.int32)
            ids[(ids < 0) | (ids >= len(table))] = len(table) - 1
            at = np.r_[0, np.cumsum(sizes[ids])][ends]
            first = 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(at, at[first] + _DECODED, "right")) - 1)
                taken = table.take(pa.array(ids[ends[first] : ends[last]]))
                offsets = pa.py_buffer((at[first : last + 1] - at[first]).astype(np.int32))
                data = pa.Array.from_buffers(pa.binary(), last - first, [None, offsets, taken.buffers()[2]])
                data = pc.if_else(lists.slice(first, last - first).is_valid(), data, None)
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in b.columns[:-1]), data], [*b.schema.names[:-1], "data"])
                first = last


def decode(encoded: DataFrame, tokenizer: GreedyTokenizer) -> DataFrame:
    """``encoded`` without its ``tokens``, with ``data``, their bytes; one pass and no shuffle. Ids out of range and special tokens give nothing, null tokens null."""
    rest = [c for c in encoded.columns if c != "tokens"]
    kinds = "".join(f"`{n}` {k}, " for n, k in encoded.dtypes if n in rest)
    plain = [t if kind in ("byte", "token") else b"" for t, kind in (tokenizer.tokens.get(i, (b"", "")) for i in range(max(tokenizer.tokens, default=-1) + 1))]
    shared = encoded.sparkSession.sparkContext.broadcast([*plain, b""])
    return encoded.select(*rest, "tokens").mapInArrow(partial(_decode, tokens=shared), f"{kinds}data binary")


def with_shortest_cost(df: DataFrame, tokenizer: GreedyTokenizer, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``cost``, the fewest tokens that give it (dynamic programming per text)."""
    from tokenmill.operators.vocab import shortest_costs

    rest = [c for c in df.columns if c != text]
    shared = df.sparkSession.sparkContext.broadcast((set(tokenizer.ids), max(map(len, tokenizer.ids), default=1)))

    @F.pandas_udf("long")
    def cost(data):  # noqa: ANN001, ANN202
        vocab, most = shared.value
        return data.map(lambda x: int(shortest_costs(bytes(x or b""), vocab, most)[-1]))

    return df.select(*rest, cost(to_bytes(text)).alias("cost"))
