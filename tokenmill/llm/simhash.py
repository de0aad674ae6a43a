"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint summarises the word shingles of a text. Two fingerprints that
differ in at most ``max_bits`` bits are linked, and documents reachable over links
form a class. To find links without comparing all pairs, the 64 bits are cut into
so few segments that, of two fingerprints within the limit, one segment differs in
at most one bit. Every fingerprint is indexed once per bit: the segment of that bit
with the bit deleted. Fingerprints that share such a variant meet in an equality
join on it, and their full distance is verified there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.texts import byte_rows, free_names, prepare, word_blocks
from tokenmill.operators.components import connected_components
from tokenmill.scratch import stage

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Of ``keep_firsts``: words of a shingle and least similarity of near copies.
VERIFY_WORDS, LEAST = 5, 0.8
#: Bands of ``keep_firsts``, each of ROWS least values of five-word shingles: texts of a similarity of 0.8 share one but for 1 in 2,700.
BANDS, ROWS = 20, 5
#: Fingerprints of one variant that are compared in one task; larger groups are compared by blocks.
GROUP = 4096
#: Texts of a class that one task takes; larger classes are first thinned out in blocks of so many.
BLOCK_TEXTS = 1_000
#: Share of the texts that a pass over blocks must drop for another one.
WORTH = 0.1
#: Shingles of texts that stay, of one class, that a task holds.
HELD = 2_000_000
_HASHES = 1 << 15


def _remixed(h: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit values."""
    x = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if it is set in over half of the shingles' hashes.

    A-Z are lower-cased. A text of fewer words than a shingle has one shingle, the
    whole sequence; a text without words (or null) has fingerprint 0.
    """
    hashed = partial(xxhash.xxh64_intdigest, seed=seed)
    ones, total, tail = np.zeros(64, np.int64), 0, []

    def take(h: np.ndarray) -> None:
        nonlocal total, ones
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)

    for words in word_blocks(text.lower() if text else b""):
        words = tail + words
        n = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False))
        for at in range(0, n, _HASHES):
            take(np.fromiter(map(hashed, shingles if n - at <= _HASHES else islice(shingles, _HASHES)), np.uint64))
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not total and tail:
        take(np.array([hashed(b" ".join(tail))], np.uint64))
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


@cache
def _mix(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, (2, n), np.uint64)


def bands(text: bytes | None, count: int = BANDS, rows: int = ROWS, seed: int = SEED) -> list[int]:
    """MinHash bands of the five-word shingles of a text, none for a text without words."""
    h = np.fromiter(shingle_set(text), np.uint64)
    if not len(h):
        return []
    mix = _mix(count * rows, seed)
    least = np.full(count * rows, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(least, ((h[at : at + 1024, None] ^ mix[0]) * (mix[1] | np.uint64(1))).min(0), out=least)
    key = np.arange(1, count + 1, dtype=np.uint64)
    for x in least.reshape(count, rows).T:
        key = _remixed(key * np.uint64(0x9E3779B97F4A7C15) + x)
    return key.view(np.int64).tolist()


def _prints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int, banded: bool = False) -> Iterator[pa.RecordBatch]:
    """Columns other than the text pass through."""
    for b in batches:
        fp = np.fromiter((fingerprint(x, shingle, seed) for x in byte_rows(b.column("text"))), np.uint64, b.num_rows)
        ids = [n for n in b.schema.names if n != "text"]
        more = [pa.array([bands(x) for x in byte_rows(b.column("text"))], pa.list_(pa.int64()))] if banded else []
        yield pa.RecordBatch.from_arrays([*map(b.column, ids), pa.array(fp.view(np.int64)), *more], [*ids, "fp", *["bands"][: len(more)]])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` for every row of ``docs``; fp holds the 64 bits as a signed BIGINT."""
    prepare(docs, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_prints, shingle=shingle, seed=seed), "doc_id long, fp long")


def _parts(max_bits: int) -> int:
    """Segments of which one differs in at most one bit if all do in ``max_bits``; two at least."""
    return max(2, (max_bits + 2) // 2)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    k = _parts(max_bits)
    cuts = [64 * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variant_rows(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``key, fp``: one row for each of the 64 one-wildcard segment variants of a fingerprint."""
    keep = [0] * 64
    for a, w in segments(max_bits):
        whole = ((1 << w) - 1) << a
        for i in range(a, a + w):
            keep[i] = _signed(whole & ~(1 << i))
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    rows = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return rows.select(F.xxhash64(F.col("fp").bitwiseAND(F.element_at(literal(keep), F.col("i") + 1)), "i").alias("key"), "fp")


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every component of a group of distinct fingerprints."""
    n = len(fps)
    label = np.arange(n)
    us, vs = [], []
    for i in range(n - 1):  # row by row: memory stays linear
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= max_bits) + i + 1
        near = near[label[near] != label[i]]
        if len(near):
            _, first = np.unique(label[near], return_index=True)
            near = near[first]
            us.append(np.full(len(near), fps[i]))
            vs.append(fps[near])
            label[np.isin(label, label[near])] = label[i]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches over the links u, v."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        now = root.copy()
        np.minimum.at(now, u, low)
        np.minimum.at(now, v, low)
        np.minimum.at(now, root, now.copy())
        now = now[now]
        if (now == root).all():
            return root
        root = now


_LINKS = pa.schema([("over", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _verify(batches: Iterator[pa.RecordBatch], max_bits: int, group: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Links among the rows of each key. Rows come sorted by key; a group over ``group`` is passed on, to be dealt to blocks."""

    def out(key, a, b, over):
        cols = [np.full(len(a), over, np.int32), key, a.view(np.int64), b.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=_LINKS)

    zero = lambda n: np.zeros(n, np.int64)
    key, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    passing = None  # key of a large group whose first rows have been passed on

    def whole(key, fps):
        """Of complete groups."""
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = sizes <= 64
        group_of = np.repeat(np.arange(len(starts)), sizes)
        ends = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for d in range(1, int(sizes[small].max(initial=1))):
            i = np.flatnonzero((group_of[d:] == group_of[:-d]) & small[group_of[d:]])
            i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= max_bits]
            ends.append((i, i + d))
        # of all pairs in the small groups, only a star for each component leaves the task
        root = _roots(len(fps), *map(np.concatenate, zip(*ends, strict=True)))
        far = np.flatnonzero(root != np.arange(len(fps)))
        us, vs = [fps[root[far]]], [fps[far]]
        for g in np.flatnonzero(~small):
            at = slice(starts[g], starts[g] + sizes[g])
            if sizes[g] > group and not last:
                yield out(key[at], fps[at], fps[at], 1)
            else:
                a, b = _forest(fps[at], max_bits)
                us.append(a)
                vs.append(b)
        a, b = np.concatenate(us), np.concatenate(vs)
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield out(zero(pairs.shape[1]), pairs[0].copy(), pairs[1].copy(), 0)

    for batch in batches:
        k, x = (batch.column(j).to_numpy() for j in range(2))
        key, fps = np.r_[key, k], np.r_[fps, x.view(np.uint64)]
        if passing is not None:
            n = int(np.searchsorted(key, passing, side="right"))
            if n:
                yield out(key[:n], fps[:n], fps[:n], 1)
                key, fps = key[n:], fps[n:]
            if len(key):
                passing = None
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut:
            yield from whole(key[:cut], fps[:cut])
            key, fps = key[cut:], fps[cut:]
        if len(key) > group and not last:
            passing = key[-1]
            yield out(key, fps, fps, 1)
            key, fps = key[:0], fps[:0]
    if len(key):
        yield from whole(key, fps)


def _in_blocks(rows: DataFrame, group: int) -> DataFrame:
    """``key, fp``: rows of large groups dealt to pairs of blocks, so that any two rows of a group meet in one."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") * 4 / group).cast("int").alias("blocks"))
    d = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("a"), "blocks").cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), F.col("a").alias("fp"))


def hamming_links(prints: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """``a, b``: links that join the same fingerprints as all pairs within ``max_bits`` bits do.

    ``prints`` has distinct fingerprints in ``fp``. Each variant's group is verified in one
    task with memory for ``group`` rows; a larger group is verified by pairs of blocks of it.
    A group, or pair of blocks, of any size returns only links that span its components, one less
    than it has rows at most. A link's ends are within ``max_bits`` of each other or joined by
    others of their group that are.
    """
    deal = lambda d, last: d.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_verify, max_bits=max_bits, group=group, last=last), "over int, key long, a long, b long")
    done, _ = stage(deal(variant_rows(prints, max_bits), False), "links")
    links = done.where("over = 0").select("a", "b")
    if done.where("over = 1").limit(1).count():
        more, _ = stage(deal(_in_blocks(done.where("over = 1").select("key", "a"), group), True), "links")
        links = links.union(more.select("a", "b"))
    return links.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row for each row of ``docs``.

    fingerprint: 16 lower-case hex digits; component_id: the smallest doc_id reachable over
    links of at most ``max_bits`` differing bits, the document itself included. Null texts
    and texts without words have fingerprint 0 and are linked like any other. Rows with a
    null doc_id keep a row and belong to their class; its component_id is null only if the
    class has no other id. Repeated rows give repeated rows; an empty table gives none.
    Further columns of ``docs`` are ignored.
    """
    prints, _ = stage(fingerprints(docs, shingle, seed), "prints")
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(hamming_links(prints.select("fp").distinct(), max_bits))
    classes = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = classes.join(firsts, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _band_links(prints: DataFrame) -> DataFrame:
    """``a, b``: each fingerprint that shares a band, with the least one that has the band."""
    rows, _ = stage(prints.select("fp", F.explode("bands").alias("band")).distinct(), "bands")
    shared = rows.groupBy("band").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a != most").select("band", "a")
    return rows.join(shared, "band").where("fp != a").select("a", F.col("fp").alias("b")).distinct()


def shingle_set(text: bytes | None, words: int = VERIFY_WORDS) -> set[int]:
    """Hashes of the different word shingles of a text, lower-cased like fingerprints; fewer words are one shingle."""
    w = (text or b"").lower().split()
    if len(w) < words:
        return {xxhash.xxh64_intdigest(b" ".join(w))} if w else set()
    return set(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(islice(w, k, None) for k in range(words)), strict=False))))


def similarity(a: set[int], b: set[int]) -> float:
    """Jaccard similarity; that of two empty sets is 1."""
    return len(a & b) / len(a | b) if a or b else 1.0


class Kept:
    """Shingle sets of the texts of one class that stay, found again by the smallest hashes of a set.

    Two sets of a similarity of ``least`` or more share one of the ``_prefix`` smallest hashes of either.
    """

    def __init__(self, least: float):
        self.least, self.size, self.sets = least, 0, []
        self.having: dict[int, list[int]] = {}

    def _prefix(self, x: np.ndarray) -> list[int]:
        return x[: len(x) - math.ceil(self.least * len(x) - 1e-9) + 1].tolist()

    def near(self, x: np.ndarray) -> bool:
        """Whether a set that stays is so similar."""
        if self.least <= 0 or not len(x):
            return any(self.least <= 0 or not len(y) for y in self.sets)
        for k in {k for h in self._prefix(x) for k in self.having.get(h, ())}:
            y = self.sets[k]
            if min(len(x), len(y)) >= self.least * max(len(x), len(y)) - 1e-9:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both / (len(x) + len(y) - both) >= self.least:
                    return True
        return False

    def add(self, x: np.ndarray) -> None:
        for h in self._prefix(x) if len(x) else ():
            self.having.setdefault(h, []).append(len(self.sets))
        self.sets.append(x)
        self.size += len(x) + 1


_KEY = ["root", "block", "doc_id", "h0", "h1"]
STAYS, GOES, OPEN = 0, 1, 2


def _copies(batches: Iterator[pa.RecordBatch], least: float, held: int) -> Iterator[pa.RecordBatch]:
    """Which members stay, go, or are open since their block has ``held`` shingles that stay. Rows come sorted by _KEY."""
    block = last = kept = None
    for b in batches:
        rows, states = [], []
        for at, (text, *key) in enumerate(zip(byte_rows(b.column("text")), *(b.column(c).to_pylist() for c in _KEY), strict=True)):
            if key == last:  # the row is repeated
                continue
            if key[:2] != block or kept is None:
                block, kept = key[:2], Kept(least)
            last, x = key, np.sort(np.fromiter(shingle_set(text), np.uint64))
            state = GOES if kept.near(x) else STAYS if kept.size < held else OPEN
            if state == STAYS:
                kept.add(x)
            rows.append(at)
            states.append(state)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in _KEY), pa.array(states, pa.int32())], [*_KEY, "state"])


def _near_copies(texts: DataFrame, members: DataFrame, least: float, held: int) -> DataFrame:
    """``doc_id, h0, h1`` of the members (``root, doc_id, h0, h1``) that go; ``texts`` has the columns but root, and text.

    Classes of over BLOCK_TEXTS members are thinned out first: dealt to blocks by a hash of the
    id, each with a task of its own, as long as such a pass drops a share of WORTH. What then
    stays of a class is taken in one order, in further passes if it has over ``held`` shingles.
    """
    members, _ = stage(members, "near-members")
    texts, _ = stage(texts.join(members.select("doc_id", "h0", "h1").hint("merge"), ["doc_id", "h0", "h1"], "left_semi"), "near-member-texts")
    gone, alone = None, False
    while True:
        sizes = members.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
        blocks = F.lit(1) if alone else F.ceil(F.col("n") / BLOCK_TEXTS)
        dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
        rows = dealt.join(texts, ["doc_id", "h0", "h1"]).select(*_KEY, "text").repartition("root", "block").sortWithinPartitions(*_KEY)
        done, _ = stage(rows.mapInArrow(partial(_copies, least=least, held=held), "root long, block int, doc_id long, h0 long, h1 long, state int"), "near-copies")
        found = done.where(F.col("state") == GOES).select("doc_id", "h0", "h1")
        gone = found if gone is None else gone.union(found)
        if alone:
            left = done.where(F.col("state") == OPEN)
        else:
            several = done.groupBy("root").agg(F.max("block").alias("most"), F.count("*").alias("n"), F.sum((F.col("state") == GOES).cast("long")).alias("went")).where("most > 0")
            total = several.agg(F.sum("n").alias("n"), F.sum("went").alias("went")).first()
            alone = not total["n"] or total["went"] < WORTH * total["n"]
            # classes of one block are done but for what is open in them
            left = done.join(several.select("root", "most"), "root", "left").where((F.col("state") == OPEN) | ((F.col("state") == STAYS) & F.col("most").isNotNull()))
        if not left.limit(1).count():
            return gone
        members, _ = stage(left.select("root", "doc_id", "h0", "h1"), "near-members")


def keep_firsts(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS, least: float = LEAST, held: int = HELD) -> DataFrame:
    """``docs`` without near copies of a document that stays.

    Equal texts leave the one of the smallest doc_id. Candidate classes come from fingerprints
    within ``max_bits`` bits, and from shared MinHash bands of five-word shingles unless ``least``
    is 0, where the fingerprints alone decide. Within a class, texts are taken by ascending
    doc_id: one goes if its five-word shingles have a Jaccard similarity of ``least`` or more with
    those of one that stays. A class of over BLOCK_TEXTS texts is first thinned out in blocks by
    the same rule. So a text only goes by a verified link, or a chain of them, to one that stays,
    and no two that are so similar both stay in a class. Null texts and texts without words are
    equal to each other. Rows that repeat doc_id and text are one document and leave one row; rows
    of one doc_id and different texts are different documents; rows without a doc_id stay. An
    empty table gives none. Other columns pass through unchanged, whatever their names.
    """
    prepare(docs, "doc_id", "text")
    text = F.col("text").cast("string")
    # 128 bits that stand for the text
    both = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), both[0].alias("h0"), both[1].alias("h1")).where("doc_id is not null")
    banded = least > 0
    prints, _ = stage(d.mapInArrow(partial(_prints, shingle=shingle, seed=seed, banded=banded), "doc_id long, h0 long, h1 long, fp long" + ", bands array<long>" * banded), "prints")
    links = hamming_links(prints.select("fp").distinct(), max_bits)
    roots = connected_components(links.union(_band_links(prints)) if banded else links)
    first = prints.groupBy("h0", "h1").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"))
    texts, _ = stage(first, "near-texts")
    equal = prints.join(texts.select("h0", "h1", "first"), ["h0", "h1"]).where("doc_id > first").select("doc_id", "h0", "h1").distinct()
    of = texts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), F.col("first").alias("doc_id"), "h0", "h1")
    several = of.groupBy("root").count().where("count > 1").select("root")
    drop, _ = stage(equal.union(_near_copies(d, of.join(several, "root", "left_semi"), least, held)), "near-drop")
    ids = free_names(docs, "id", "h0", "h1", "n")
    same = [F.col("doc_id").cast("long") == F.col(ids[0]), both[0] == F.col(ids[1]), both[1] == F.col(ids[2])]
    # both sides grow with the corpus: one plan at every size
    drop = drop.toDF(*ids[:3]).hint("merge")
    kept = docs.join(drop, same[0] & same[1] & same[2], "left_anti")
    again = prints.groupBy("doc_id", "h0", "h1").count().where("count > 1").select("doc_id", "h0", "h1").toDF(*ids[:3])
    if not again.limit(1).count():
        return kept
    # only rows that are repeated are dealt out by their text
    once = kept.join(again, same[0] & same[1] & same[2], "left_semi").withColumn(ids[3], F.row_number().over(Window.partitionBy("doc_id", *both).orderBy(F.lit(1))))
    return kept.join(again, same[0] & same[1] & same[2], "left_anti").unionByName(once.where(F.col(ids[3]) == 1).drop(ids[3]))
