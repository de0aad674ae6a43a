import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tokenmill.llm import simhash
from tokenmill.llm.simhash import fingerprint, hamming_links, keep_firsts, near_duplicates
from tokenmill.operators.components import connected_components


def brute_print(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(prints, bits=3):
    """Class of each fingerprint by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ps = sorted(prints)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in ps}


def test_fingerprints():
    r = random.Random(3)
    for text in [None, "", " \n", "One", "One twö", "ÀB A b\tc\x0bd", *(" ".join(r.choices(["a", "B", "é", "xyz"], k=n)) for n in (3, 4, 50, 40_000))]:
        assert fingerprint(text.encode() if text is not None else None) == brute_print(text)


def test_classes_match_all_pairs(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdef", k=4)) for _ in range(300)]
    rows = []
    for i in range(150):
        if rows and r.random() < 0.5:
            w = (r.choice(rows)[1] or "").split()
            if w and r.random() < 0.7:
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = r.choices(words, k=r.choice([0, 1, 2, 30, 200]))
        rows.append((i + 10, " ".join(w)))
    rows += [(3, None), (4, ""), (None, rows[9][1]), (None, "alone here now"), (10, rows[0][1])]
    got = near_duplicates(spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, fp string")).collect()
    root = classes({brute_print(t) for _, t in rows})
    least = {}
    for i, t in rows:
        if i is not None:
            k = root[brute_print(t)]
            least[k] = min(i, least.get(k, i))
    want = [(i, f"{brute_print(t):016x}", least.get(root[brute_print(t)])) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = keep_firsts(spark.createDataFrame(rows, "doc_id long, text string"), max_bits=3, least=0.0).collect()
    assert sorted(k.doc_id for k in kept if k.doc_id is not None) == sorted(set(least.values()))
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_go_and_others_stay(spark):
    r = random.Random(7)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(2000)]
    rows, copies = [], []
    for i in range(60):
        text = r.choices(words, k=250)
        rows.append((i, " ".join(text)))
        copy = list(text)
        copy[r.randrange(250)] = "changed"
        copies.append((100 + i, " ".join(copy)))
    rows += copies + [(300, rows[0][1]), (301, ""), (302, None), (303, "two words"), (304, "other words"), (300, rows[0][1]), (None, rows[0][1])]
    d = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, component_id int")
    kept = [k.doc_id for k in keep_firsts(d).collect()]
    ids = [k for k in kept if k is not None]
    assert set(range(60)) <= set(ids) and len(ids) == len(set(ids)) and None in kept and {301, 303, 304} <= set(ids)
    assert 300 not in ids and 302 not in ids and sum(k in ids for k in range(100, 160)) <= 3


@pytest.mark.parametrize("bits,group", [(3, 2048), (3, 70), (7, 90)])
def test_links_of_dense_groups(spark, bits, group):
    r = np.random.default_rng(1)
    base = int(r.integers(0, 2**63))
    prints = {base ^ int(sum(1 << int(b) for b in r.choice([0, 1, 2, 5, 9, 33, 34, 40, 50, 60, 61, 62, 63], r.integers(0, 9), replace=False))) for _ in range(400)}
    prints |= {int(x) for x in r.integers(0, 2**63, 100)} | {0, 1, 2**64 - 1, 2**63}
    signed = [(simhash._signed(p),) for p in prints]
    links = hamming_links(spark.createDataFrame(signed, "fp long"), bits, group).persist()
    assert links.count() <= 64 * len(prints)
    found = {x.node & (2**64 - 1): x.root & (2**64 - 1) for x in connected_components(links).collect()}
    want = classes(prints, bits)
    same = {}
    for p in prints:
        assert same.setdefault(want[p], found.get(p, p)) == found.get(p, p)
    assert len(set(same.values())) == len(set(want.values()))


@pytest.mark.parametrize("n", [2, 3, 56, 64, 65, 300])
def test_a_group_gives_spanning_links_only(n):
    """n fingerprints of one key that are all near each other, between keys of unlinked ones."""
    near = np.array([1 << 40 | i % 8 << 4 | (i // 8 % 8) << 10 | (i // 64) << 20 for i in range(n)], np.uint64).view(np.int64)
    apart = np.random.default_rng(n).integers(-(2**63), 2**63, 40)
    key = np.r_[np.full(20, 1), np.full(n, 5), np.full(20, 9)]
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.r_[apart[:20], near, apart[20:]])], ["key", "fp"])
    found = list(simhash._verify(iter([batch.slice(0, 21), batch.slice(21)]), 8, simhash.GROUP, False))
    links = [(a, b) for x in found for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)]
    assert len(links) == n - 1 and {x for link in links for x in link} == set(near.tolist())


@pytest.mark.parametrize("copies", [1, 3])
def test_classes_are_thinned_out_in_blocks(spark, monkeypatch, copies):
    """A class of 60 texts by a drifting chain, in blocks of seven: no two that are near stay, and copies of all go."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 7)
    r = random.Random(21)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(2000)]
    text, rows = r.choices(words, k=200), []
    for i in range(60):
        text = list(text)
        text[r.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(text)))
    rows = [(100 * c + i, t) for c in range(copies) for i, t in rows]
    got = sorted(k.doc_id for k in keep_firsts(spark.createDataFrame(rows, "doc_id long, text string"), max_bits=40).collect())
    sets = {i: simhash.shingle_set(t.encode()) for i, t in rows}
    assert got[0] == 0 and 2 <= len(got) < 20 and max(got) < 100
    assert all(simhash.similarity(sets[a], sets[b]) < 0.8 for a in got for b in got if a < b)


def test_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, __h0 string, fp int, root string, state timestamp"
    assert keep_firsts(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f", "x", 1, "r", None), (2, "a b c d e f", "y", 2, None, None), (1, "a b c d e f", "x", 1, "r", None), (3, None, "z", 3, None, None), (4, "", "w", 4, None, None)]
    got = keep_firsts(spark.createDataFrame(rows, schema)).collect()
    assert sorted((k.doc_id, k["__h0"]) for k in got) == [(1, "x"), (3, "z")]


@pytest.mark.parametrize("held", [simhash.HELD, 1])
def test_copies_at_the_end_of_a_chain_go(spark, held):
    """C is too far from A, but linked to it by B; D equals C and E is near it."""
    r = random.Random(9)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(2000)]
    a = r.choices(words, k=400)

    def changed(text, places):
        return [f"new{k}" if k in places else w for k, w in enumerate(text)]

    b = changed(a, range(20, 380, 30))
    c = changed(b, range(30, 380, 30))
    e = changed(c, [200])
    rows = [(1, a), (5, c), (7, b), (9, c), (11, e), (20, r.choices(words, k=400))]
    near = lambda x, y: simhash.similarity(*(simhash.shingle_set(" ".join(t).encode()) for t in (x, y)))
    assert near(a, c) < 0.8 <= near(c, e)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = sorted(k.doc_id for k in keep_firsts(d, max_bits=40, held=held).collect())
    want = []
    for i, t in rows:
        if all(near(t, dict(rows)[j]) < 0.8 for j in want):
            want.append(i)
    assert got == want and not {9, 11} & set(got)


def test_near_copies_of_every_similarity_go(spark):
    """By band of five-word similarity, against the similarity of all planted pairs."""
    r = random.Random(11)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows, band = [], {}
    for i in range(150):
        text = r.choices(words, k=300)
        places = set(r.sample(range(300), r.randint(1, 7)))
        copy = ["new" if k in places else w for k, w in enumerate(text)]
        rows += [(i, " ".join(text)), (1000 + i, " ".join(copy))]
        s = simhash.similarity(*(simhash.shingle_set(t.encode()) for _, t in rows[-2:]))
        if s >= 0.8:
            band.setdefault(min(int(s * 20), 18), []).append(1000 + i)
    kept = {k.doc_id for k in keep_firsts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(150)) <= kept and all(len(band[k]) >= 10 for k in (16, 17, 18))
    assert not kept & {i for ids in band.values() for i in ids}


def test_other_text_of_a_repeated_id_stays(spark):
    r = random.Random(13)
    first, other = (" ".join(f"w{r.randrange(5000)}" for _ in range(100)) for _ in range(2))
    rows = [(1, first), (7, first), (7, other), (8, first + " more"), (8, other + " more")]
    got = keep_firsts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, first), (7, other)]
