"""Benchmark decontamination with a generalised suffix automaton.

The automaton accepts every run of words of any test item. A document's words are streamed
through it once; its state tracks the longest run that ends at the current word and occurs in
an item. Where that length reaches the window, the window's words are hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tokenmill.llm.texts import byte_rows, free_names, map_rows, prepare, word_blocks

WINDOW = 10
MAX_COVERAGE = 0.5
#: Words of test items in one automaton; more items make more automata, each with a pass over the documents.
BLOCK_WORDS = 200_000

#: Lower-cases A-Z and turns every other byte than 0-9, a-z and those above 0x7F into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class SuffixAutomaton:
    """Over the word sequences of items; ``finish`` prepares the search for windows."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int | None, list[int]]] = []
        self.words = 0

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the longest run of p extended by c, taken out of q if q also has longer runs."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, item_id: int | None, words: list[bytes]) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self.items.append((item_id, ids))
        self.words += len(ids)
        last = 0
        for c in ids:
            if c in self.next[last]:
                last = self._split(last, c, self.next[last][c])
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new

    def finish(self) -> SuffixAutomaton:
        """Find each state's window (the state of its last ``window`` words) and the items of windows and of short items."""
        n = self.window
        self.home = [-1] * len(self.link)
        self.short: dict[int, list[tuple[int, int | None]]] = {}
        self.of: dict[int, set[int]] = {}
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for s in by_length:
            if self.length[s] >= n:
                self.home[s] = s if self.length[self.link[s]] < n else self.home[self.link[s]]
        for item_id, ids in self.items:
            s = 0
            for i, c in enumerate(ids):
                s = self.next[s][c]
                if i + 1 >= n:
                    self.of.setdefault(self.home[s], set()).update([item_id] if item_id is not None else [])
            if 0 < len(ids) < n:
                self.short.setdefault(s, []).append((len(ids), item_id))
        #: Nearest state on the way to the root, itself included, that ends a short item; -1: none.
        self.ends = [-1] * len(self.link)
        for s in by_length:
            self.ends[s] = s if s in self.short else self.ends[self.link[s]] if self.link[s] > 0 else -1
        self.items = []
        return self

    def search(self, blocks: Iterable[list[bytes]]) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, spans of hit words (first, end) in order and apart, and ids of items with a window."""
        moves, link, length, home, ends, n = self.next, self.link, self.length, self.home, self.ends, self.window
        state, matched, at = 0, 0, -1
        spans: list[list[int]] = []
        windows, items = set(), set()

        def hit(first: int, end: int) -> None:
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append([first, end])

        for words in blocks:
            for at, c in enumerate(map(self.vocabulary.get, words), at + 1):
                if c is None:
                    state = matched = 0
                    continue
                to = moves[state].get(c)
                if to is None:
                    while to is None and state:
                        state = link[state]
                        to = moves[state].get(c)
                    matched = length[state]
                    if to is None:
                        continue
                state = to
                matched += 1
                if matched >= n:
                    windows.add(home[state])
                    hit(at - n + 1, at + 1)
                s = ends[state]
                while s > 0:
                    for size, item in self.short[s] if s in self.short else ():
                        if size <= matched:
                            if item is not None:
                                items.add(item)
                            hit(at - size + 1, at + 1)
                    s = ends[link[s]] if link[s] > 0 else -1
        for w in windows:
            items |= self.of.get(w, set())
        return at + 1, [(a, b) for a, b in spans], items


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, unnamed: bool = False) -> Iterator[SuffixAutomaton]:
    """Automata over blocks of items; the driver holds one block at a time. Items without words are left out, those with a null id unless ``unnamed``."""
    block = SuffixAutomaton(window)
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    rows = rows if unnamed else rows.where("item_id is not null")
    for item_id, text in rows.toLocalIterator():
        if words := item_words(text):
            if block.words and block.words + len(words) > block_words:
                yield block.finish()
                block = SuffixAutomaton(window)
            block.add(item_id, words)
    yield block.finish()


def _search(batches: Iterator[pa.RecordBatch], automaton, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, spans, items = [], [], []
        for data in byte_rows(b.column("text")):
            words, found, ids = automaton.value.search(word_blocks((data or b"").translate(_FOLD)))
            n.append(words)
            spans.append([x for s in found for x in s])
            items.append(sorted(ids))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], [*b.schema.names, *names])


def merged(spans: list[int]) -> list[tuple[int, int]]:
    """Spans given as first, end, first, end, ... in any order, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def search(docs: DataFrame, items: DataFrame, names: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS, unnamed: bool = False) -> DataFrame:
    """The columns of ``docs``, and under ``names``, which it doesn't have, the number of words, the spans and the items of each row; spans (first, end, ...) may touch if there are several automata."""
    sc = docs.sparkSession.sparkContext
    schema = lambda more: StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(more, [LongType(), ArrayType(IntegerType()), ArrayType(LongType())] * 2, strict=False)]])
    now, n, spans, ids = docs, *names
    work = free_names(docs.select("*", *[F.lit(0).alias(x) for x in names]), "n", "spans", "items")
    for k, automaton in enumerate(automata(items, window, block_words, unnamed)):
        step = partial(_search, automaton=sc.broadcast(automaton), names=names)
        if not k:
            now = map_rows(now, step, schema(names))
            continue
        both = map_rows(now.withColumnsRenamed(dict(zip(names, work, strict=True))), step, schema([*work, *names]))
        kept = [F.col(f"`{c}`") for c in docs.columns]
        now = both.select(*kept, n, F.concat(work[1], spans).alias(spans), F.array_union(work[2], ids).alias(ids))
    return now


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit = [sum(e - a for a, e in merged(s)) for s in b.column("spans").to_pylist()]
        ids = b.column("items").to_pylist()
        sha = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in ids]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row for each row of ``docs``.

    Words are runs of 0-9, letters and characters above U+007F, A-Z lower-cased; null has none. A
    window is ``window`` consecutive words of an item, or all words of a shorter item; a document
    word inside any occurrence of a window is hit. n_items counts different item_ids with an
    occurring window; items_sha256 is over those ids, sorted as strings and comma-joined. Items
    without words or with a null id are left out; no items or an empty table are fine. Repeated
    rows and null doc_ids keep a row each; further columns are ignored.
    """
    prepare(docs, "doc_id", "text")
    prepare(items, "item_id", "text")
    found = search(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), items, ["n_words", "spans", "items"], window, block_words)
    return found.drop("text").mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    for i, m in enumerate(_WORD.finditer(text)):
        first, end = spans[k]
        if i == first:
            out.append(text[at : m.start()])
        if i == end - 1:
            at, k = m.end(), k + 1
            if k == len(spans):
                break
    return b"".join([*out, text[at:]])


def _clean(batches: Iterator[pa.RecordBatch], names: list[str], max_coverage: float, min_words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, keep = [], []
        for data, n, spans in zip(byte_rows(b.column("text")), *(b.column(c).to_pylist() for c in names[:2]), strict=True):
            found = [s for s in merged(spans) if s[1] - s[0] >= min_words]
            keep.append(sum(e - a for a, e in found) <= max_coverage * n if found else True)
            texts.append(cut(data, found).decode() if found and keep[-1] else data.decode() if data is not None else None)
        left = [c for c in b.schema.names if c not in names]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in left], left).filter(pa.array(keep))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_words: int = 1, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the words of hit spans of at least ``min_words`` words; a document goes if they are over ``max_coverage`` of its words.

    Items with a null id count like any other. Documents without such spans stay as they are, null and empty texts
    and repeated rows included; no items or an empty table are fine. Other columns pass through unchanged, whatever
    their names.
    """
    prepare(docs, "text")
    prepare(items, "item_id", "text")
    names = free_names(docs, "n_words", "spans", "items")
    found = search(docs, items, names, window, block_words, unnamed=True)
    return map_rows(found, partial(_clean, names=names, max_coverage=max_coverage, min_words=min_words), docs.schema)
