"""Odd rows and larger tables: query against SQL, and steps whose memory or rows must not grow with the input."""

import duckdb
import pytest

import __spark_entry__ as entry


def by_sql(name, **tables):
    c = duckdb.connect()
    for t, df in tables.items():
        c.register(t, df.toArrow())
    return sorted(map(tuple, c.execute(entry.oracle_sql()[name]).fetchall()), key=repr)


def by_spark(spark, tmp_path, name, **tables):
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
    return sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()), key=repr)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")


ODD = [None, "", "x", " ", "a" * 13 + "\x0b" * 14, "a\x0bb" * 9, "x\x1cy" * 9, "\xa0" * 20, "ab " * 20, "é" * 700, "x\r\n" * 700, "日本　" * 500, "a\x00b" * 30]


def test_run_slices_of_odd_texts(spark, tmp_path):
    d = documents(spark, ODD)
    d = d.union(d.where("doc_id = 9"))
    want = by_sql("run_slices", documents=d)
    assert by_spark(spark, tmp_path, "run_slices", documents=d) == want and len(want) == len(ODD) - 2


def test_batches_of_encoded_and_decoded_rows_are_bounded(monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace as Shared

    from tokenmill.operators import codec

    t = codec.GreedyTokenizer([*[(i, bytes([i]), "byte") for i in range(256)], (256, b"ab", "token"), (257, b"", "eot")])
    monkeypatch.setattr(codec, "_ENCODED", 50)
    texts = [b"abc" * 20, None, b"", b"x", b"ab" * 200, b"y" * 49, None]
    whole = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.binary())], ["id", "b"])
    parts = list(codec._encode(iter([whole]), Shared(value=t), True))
    assert len(parts) > 2 and max(len(p.column(2).flatten()) - len(p.column(2)[-1]) for p in parts) < 50
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(7))
    assert [x for p in parts for x in p.column(2).to_pylist()] == [[257, *t.walk(x or b"")] for x in texts]
    table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    back = list(codec._decode(iter([table.select(["id", "tokens"])]), Shared(value=[*[bytes([i]) for i in range(256)], b"ab", b""])))
    assert len(back) > 2 and [x for p in back for x in p.column(1).to_pylist()] == [x or b"" for x in texts]


def test_pattern_takes_the_longest_match():
    import pickle
    import random

    from tokenmill.operators.codec import GreedyTokenizer

    r = random.Random(1)
    for case in range(60):
        alphabet = b"ab\n" if case % 2 else b"a.*[^\x00\xff|"
        word = lambda: bytes(r.choice(alphabet) for _ in range(r.randint(2, 9)))  # noqa: E731, B023
        rows = [(256 + i, t, "token") for i, t in enumerate({word() for _ in range(r.randint(0, 20))})]
        t = pickle.loads(pickle.dumps(GreedyTokenizer([*[(i, bytes([i]), "byte") for i in range(256)], *rows, (999, b"", "eot")])))
        data = b"".join(word() for _ in range(40))
        assert t.encode_bytes(data) == t.walk(data) and t.decode(t.encode_bytes(data)) == data


def test_grams_of_every_size_from_one_sort(spark, monkeypatch):
    import random
    from collections import Counter

    import pyarrow as pa

    from tokenmill.operators import ngrams

    r = random.Random(2)
    texts = [None, "", "a", "ab\x00", "\x00" * 9, "é" * 3, *("".join(r.choice("ab\x00é ") for _ in range(r.randint(0, 40))) for _ in range(150)), None]
    brute = lambda n: Counter((n, b[i : i + n].hex().upper()) for b in ((t or "").encode() for t in texts) for i in range(len(b) - n + 1))
    d = documents(spark, texts).repartition(3)
    for sizes in ((1,), (2, 3), (3, 5), (2, 5, 8), (8,), (7, 4), (1, 2, 3, 4, 5, 6, 7, 8)):
        got = ngrams.ngram_counts(d, sizes).collect()
        assert len({(x.n, x.gram) for x in got}) == len(got)
        assert {(x.n, x.gram): x.freq for x in got} == sum((brute(n) for n in sizes), Counter())
    # blocks of some bytes, merged and passed on in between
    monkeypatch.setattr(ngrams, "_BLOCK", 64), monkeypatch.setattr(ngrams, "_HELD", 40), monkeypatch.setattr(ngrams, "_OUT", 7)
    monkeypatch.setattr(ngrams.flat, "__defaults__", (64,))
    batch = pa.RecordBatch.from_arrays([pa.array([t and t.encode() for t in texts], pa.binary()).slice(2)], ["b"])
    parts = list(ngrams._windows(iter([batch]), (2, 3, 5, 8), 4))
    assert len(parts) > 50
    got = Counter()
    for p in ngrams._derived(iter(parts), (2, 3, 5, 8), 4):
        for n, x, f in zip(*(c.to_pylist() for c in p.columns), strict=True):
            key = (n, (x % (1 << 64)).to_bytes(8, "big")[8 - n :].hex().upper())
            assert key not in got
            got[key] = f
    assert got == sum((brute(n) for n in (2, 3, 5, 8)), Counter())


def test_rows_of_grams_that_are_shuffled():
    """A task passes on one row for each different window of the largest size, not one for each size and block."""
    import numpy as np
    import pyarrow as pa

    from tokenmill.operators import ngrams

    data = np.random.default_rng(3).integers(97, 105, 1 << 16).astype(np.uint8).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["b"])
    step = ngrams._windows if hasattr(ngrams, "_windows") else None
    rows = sum(p.num_rows for p in (step(iter([batch] * 8), (4, 5, 6, 7, 8), 4)))
    assert rows <= len({data[i : i + 8] for i in range(len(data) - 7)}) + 7


@pytest.mark.parametrize("step", ["records", "steps_once", "val_curve"])
def test_a_log_run_of_any_size_is_many_tasks(spark, monkeypatch, step):
    from functools import partial

    from tokenmill.operators import logs

    lines = [(run, i * 3, f"step {i}/9 | train loss {i}.5" if i % 5 in (1, 2) else f"val loss {i}.25" if i % 5 != 4 else f"step {i} val loss {i}.75 train loss 1") for run in ("a", "b", None) for i in range(60)]
    d = spark.createDataFrame(lines, "run string, line_no long, line string").repartition(4)
    rows = d if step == "steps_once" else logs.parsed(d)
    want = getattr(logs, step)(rows)  # one range
    if hasattr(logs, "ranges"):
        monkeypatch.setattr(logs, "ranges", partial(logs.ranges, block=7))
    got = getattr(logs, step)(rows)
    plan = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert plan and all("__range" in x or "__run" in x for x in plan)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 60


@pytest.mark.parametrize("order", [1, 2, 3])
def test_segments_by_table_are_those_by_place(spark, order):
    import random
    from collections import Counter

    import numpy as np

    from tokenmill.operators import bytelm, segment

    r = random.Random(order)
    texts = [None, "", "a", "ab", "é", "\x00" * 40, *("".join(r.choice("aab\x00é c") * r.randint(1, 3) for _ in range(r.randint(1, 90))) for _ in range(60))]
    d = documents(spark, texts).repartition(3)
    lm = bytelm.train_lm(d.where("doc_id % 4 != 0"), order)  # so that triples of the texts are not in the model
    data = [(t or "").encode() for t in texts]
    h = Counter(x for t in data for x in lm.surprise(np.frombuffer(t, np.uint8)).tolist())
    hist = bytelm.surprise_histogram(d, lm)
    assert {x.h: x.n for x in hist.collect()} == h
    tau = bytelm.threshold(hist, 0.7)
    for most in (1, 3, 8, 9, 16, 20):
        want = Counter(t for x in data for t in segment.chopped(x, lm, tau, most))
        assert {bytes(x.token): x.freq for x in segment.segment_counts(d, lm, tau, most).collect()} == want
        one, two = Counter(), Counter()
        for x in data:
            s = segment.segments(x, lm, tau)
            one.update(t for t in s if 2 <= len(t) <= most)
            two.update(a + b for a, b in zip(s, s[1:]) if len(a) + len(b) <= most)
        assert {bytes(x.token): x.freq for x in segment.segment_pair_counts(d, lm, tau, most).collect()} == dict((one | two).items())


def test_surprise_is_scored_by_gram(spark):
    """Places of texts are not scored one by one: the scored rows are the different grams."""
    from tokenmill.operators import bytelm

    d = documents(spark, ["abcabcabd" * 50] * 20)
    lm = bytelm.train_lm(d)
    plan = bytelm.surprise_histogram(d, lm)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow partial(gram#" in plan


@pytest.mark.parametrize("bits,margin", [(6, True), (3, False), (12, False)])
def test_most_frequent_grams_without_all_counts(spark, monkeypatch, bits, margin):
    """The same rows, ties included, as from all counts: also where buckets collide and where the first threshold is too high."""
    import random

    from pyspark.sql import functions as F

    from tokenmill.operators import ngrams

    if not margin:
        monkeypatch.setattr(ngrams, "_threshold", lambda totals, k: int(totals.max()))
    r = random.Random(bits)
    words = ["".join(r.choice("ab\x00é ") for _ in range(r.randint(1, 12))) for _ in range(12)]
    texts = [None, "", "a", *("".join(r.choices(words, range(1, 13), k=r.randint(0, 9))) for _ in range(120))]
    d = documents(spark, texts).repartition(3)
    for table, sizes in ((d, (2, 3, 4, 5, 6, 7, 8)), (d, (1, 8)), (d.where("doc_id < 3"), (1, 2, 3)), (d.limit(0), (4,))):
        counts = ngrams.ngram_counts(table, sizes).persist()
        for k in (1, 60, 10_000):
            key = lambda rows: sorted(tuple(x) for x in rows)
            assert key(ngrams.most_frequent(table, k, sizes, bits=bits).collect()) == key(ngrams.top_grams(counts, k).collect())
        for k in (20,):
            assert key(ngrams.most_frequent_per_size(table, k, sizes, bits=bits).collect()) == key(ngrams.top_per_size(counts, k).select("n", "gram", "freq", F.col("rank")).collect())
        counts.unpersist()


def test_rows_of_frequent_grams_do_not_grow_with_the_text(spark):
    """Only grams of buckets that reach the threshold are shuffled, not every different window."""
    import numpy as np
    import pyarrow as pa

    from tokenmill.operators import ngrams

    r = np.random.default_rng(5)
    text = lambda n: pa.RecordBatch.from_arrays([pa.array([b"frequent " * (n // 90) + r.integers(97, 123, n).astype(np.uint8).tobytes()], pa.binary())], ["b"])
    rows = []
    for n in (1 << 17, 1 << 20):
        batch = text(n)
        totals = {8: np.concatenate([np.frombuffer(x, f"u{w}") for b in ngrams._bucketed(iter([batch]), (8,), 18) for w, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)])}
        mask = np.packbits(totals[8] >= n // 100).tobytes()
        rows.append(sum(p.num_rows for p in ngrams._within(iter([batch]), {8: mask}, 18)))
    assert max(rows) < 200
