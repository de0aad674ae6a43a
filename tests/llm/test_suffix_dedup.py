import datetime
import decimal
import hashlib
import random

import numpy as np
import pytest

from tokenmill.llm import repeats, suffix_dedup
from tokenmill.llm.repeats import runs
from tokenmill.llm.suffix_dedup import SPEC, common_prefixes, remove_repeats, suffix_array


def brute(rows, window=100):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = True
            seen.add(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[rows[i][0]] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["ab", "né", "the", "x", "quite", "zz\x00z", "of", "longer"] + ["".join(r.choices("abcde", k=6)) for _ in range(200)]
    shared = [" ".join(r.choices(words, k=40)) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.1:
            t = "be " * r.randint(1, 120)
        elif kind < 0.2 and rows:
            t = r.choice(rows)[1]
        elif kind < 0.4 and rows:
            t = r.choice(rows)[1] or ""
            at = r.randint(0, len(t))
            t = t[:at] + "CHANGED" + t[at:]
        else:
            t = " ".join(r.choices(words, k=r.randint(0, 80))) + " " + r.choice(shared) + " " + " ".join(r.choices(words, k=r.randint(0, 50)))
            if r.random() < 0.3:
                t += t[: r.randint(0, len(t))]
        rows.append((i * 3, t))
    return rows + [(n * 3, ""), (n * 3 + 1, None), (n * 3 + 2, "\x00" * 250), (None, rows[4][1])]


@pytest.mark.parametrize("seed,sub", [(1, 1 << 14), (2, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, sub):
    rows = corpus(seed)
    if sub != 1 << 14:
        real = repeats.meet

        def meet(rows, strict, index=False):
            from functools import partial

            def small(batches):
                repeats.SUB = sub
                yield from repeats._meet(batches, strict, index)

            return rows.repartition("h").sortWithinPartitions("h", "digest", "dk", "tk", "at").mapInArrow(small, repeats.MET)

        monkeypatch.setattr(suffix_dedup, "meet", meet)
        assert real is not meet
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if seed == 2 else 10000)
    try:
        got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(rows)
    assert {r.doc_id: (r.n, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert len(got) == len(rows)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kind int, h string")
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    rows = [(1, "q" * 150, 1, "x"), (1, "q" * 150, 1, "x")]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, empty.schema), keep=True).collect()
    assert [(r.doc_id, r.n_removed, bytes(r.kept)) for r in got] == [(1, 149, b"q")] * 2 or len(got) == 2


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    r = np.random.default_rng(seed)
    text = r.integers(0, [2, 3, 256][seed % 3], [0, 1, 50, 400, 700, 33][seed], dtype=np.uint8)
    if seed == 4:
        text = np.tile(text[:20], 35)
    data = text.tobytes()
    sa = suffix_array(text)
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    lcp = common_prefixes(text, sa)

    def common(a, b):
        n = 0
        while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        return n

    assert lcp.tolist() == [0] * bool(len(sa)) + [common(a, b) for a, b in zip(sa[:-1], sa[1:])]


def test_other_columns_stay_as_they_are(spark):
    """Types that JSON would bend, names of work columns, repeated and null rows."""
    schema = "doc_id int, text string, rest timestamp, kind decimal(20,10), dk binary, late map<string,int>, kept array<struct<a:double>>"
    at, text = datetime.datetime(2024, 1, 2, 3, 4, 5, 123456), "the quick brown fox jumps over it " * 10
    more = (at, decimal.Decimal("1234567890.0123456789"), bytearray(b"\x00\xff"), {"a": 1}, [(float("nan"),)])
    rows = [(1, text, *more), (2, "x" + text + "y", *more), (2, "x" + text + "y", *more), (3, None, None, None, None, None, None), (4, "", *more), (None, "short", *more)]
    got = remove_repeats(spark.createDataFrame(rows, schema))
    assert got.dtypes == spark.createDataFrame([], schema).dtypes
    got = got.collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "2", "2", "3", "4", "None"]
    for x in got:
        if x.doc_id != 3:
            assert x.rest == at and x.kind == more[1] and bytes(x.dk) == b"\x00\xff" and x.late == {"a": 1} and x["kept"][0].a != x["kept"][0].a
    assert {x.text for x in got if x.doc_id == 2} == {"xy"} and {x.doc_id: x.text for x in got if x.doc_id in (3, 4)} == {3: None, 4: ""}
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0


def test_a_window_chooses_the_same_gram_wherever_it_stands():
    """By all bits of the hash: in long and short texts alike."""
    r = np.random.default_rng(4)
    part = r.integers(0, 2**63, 150, np.uint64)
    long = np.concatenate([r.integers(0, 2**63, 70_000, np.uint64), part, r.integers(0, 2**63, 500, np.uint64)])
    a = {x for x in zip(*(y.tolist() for y in runs(part, SPEC)[:2]), strict=True)}
    h, d, first, size = runs(long, SPEC)
    inside = (first >= 70_000) & (first + size - 1 + SPEC.window <= 70_150)
    assert len(a & set(zip(h[inside].tolist(), d[inside].tolist(), strict=True))) >= max(1, len(a) - 2)
    brute = []
    for j in range(len(part) - SPEC.window + 1):
        grams = runs_gram(part[j : j + SPEC.window])
        brute.append(j + min(range(len(grams)), key=lambda k: (grams[k], k)))
    _, _, first, size = runs(part, SPEC)
    got = np.repeat(np.arange(len(first)), size)
    assert [x == y for x, y in zip(brute, brute[1:])] == (got[1:] == got[:-1]).tolist()


def runs_gram(u):
    """Hash of each gram of a window, from a window of one gram."""
    one = SPEC._replace(window=SPEC.gram)
    return [int(runs(u[i : i + SPEC.gram], one)[0][0]) for i in range(len(u) - SPEC.gram + 1)]
