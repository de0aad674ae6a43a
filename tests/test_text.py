import itertools
import random

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import bytelm, codec, corpus, metrics, minhash, ngrams, pack, segment, vocab
from tokenmill.operators.components import connected_components
from tokenmill.operators.prefix import running_sum

TEXT = "Hello world! This is a tokenizer test, hello again. "


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(0, "abab"), (1, ""), (2, "é"), (3, "x"), (4, "aaaa"), (5, None)], "doc_id long, text string")


def brute_counts(texts, n):
    out = {}
    for t in texts:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            k = b[i : i + n].hex().upper()
            out[k] = out.get(k, 0) + 1
    return out


def test_ngram_counts(tiny):
    texts = [r.text for r in tiny.collect()]
    got = ngrams.ngram_counts(tiny, (1, 2, 3, 8)).collect()
    for n in (1, 2, 3, 8):
        assert {r.gram: r.freq for r in got if r.n == n} == brute_counts(texts, n)
    assert {r.gram: r.freq for r in ngrams.ngram_counts_sql(tiny, 2).collect()} == brute_counts(texts, 2)
    long = tiny.sparkSession.createDataFrame([(0, "\x00\x01é" * 9)], "doc_id long, text string")
    assert {r.gram: r.freq for r in ngrams.ngram_counts(long, (8,)).collect()} == brute_counts(["\x00\x01é" * 9], 8)
    with pytest.raises(ValueError):
        ngrams.ngram_counts(tiny, (9,))


def test_round_trip_of_every_vocabulary(spark):
    d = spark.createDataFrame([(i, TEXT * 40 + f"<|pad|>{i}<|endoftext|> ünïcode") for i in range(5)], "doc_id long, text string")
    for v in (vocab.frequency_vocab(d, 512, 2, 6), vocab.cluster_vocab(d, 320, 5), vocab.independent_vocab(d, 300, 3), vocab.entropy_vocab(d, 300), vocab.gain_vocab(d, 300, 2_000), vocab.layout(spark, [], 300)):
        rows = v.orderBy("token_id").collect()
        assert [r.token_id for r in rows] == list(range(len(rows))) and rows[-1].kind == "eot"
        tokens = [bytes(r.token) for r in rows if r.kind in ("byte", "token")]
        assert len(set(tokens)) == len(tokens)
        t = codec.load_tokenizer(v)
        assert isinstance(t, codec.TokenizerLike)
        text = d.first().text
        assert t.decode_str(t.encode(text)) == text and t.encode_with_eot("a")[0] == len(rows) - 1
        back = codec.decode_rows(codec.token_rows(codec.encode(d, t), "doc_id"), v, "doc_id").collect()
        assert {r.doc_id: bytes(r.data).decode() for r in back} == {r.doc_id: r.text for r in d.collect()}
        cost = codec.with_shortest_cost(d, t).first().cost
        assert cost <= len(t.encode(text))


def test_greedy_takes_the_longest(spark):
    t = codec.load_tokenizer(vocab.layout(spark, [b"ab", b"abc", b"bcd"], 300))
    assert t.encode("abcd") == [257, ord("d")] and t.encode("abab") == [256, 256] and t.decode([256, 9999, 299, 65]) == b"abA"


def test_decoding_of_arrays(spark):
    t = codec.load_tokenizer(vocab.layout(spark, [b"ab", "é".encode()], 300))
    rows = [(0, [256, 9999, 299, 65, -1]), (1, []), (2, None), (3, [257]), (4, [256, 256]), (4, [66]), (None, [67])]
    d = spark.createDataFrame(rows, "id long, tokens array<int>")
    got = sorted(((r.id, r.data if r.data is None else bytes(r.data)) for r in codec.decode(d, t).collect()), key=repr)
    assert got == sorted([(i, None if x is None else t.decode(x)) for i, x in rows], key=repr)
    assert codec.decode(d.limit(0), t).count() == 0
    plan = codec.decode(d, t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_small_batches_of_decoded_rows(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(codec, "_DECODED", 5)

    class Shared:
        value = [b"abc", b"d", b""]

    lists = pa.array([[0, 0, 0], [], [1], None, [0, 1], [7]], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists], ["id", "tokens"])
    for b in (batch, batch.slice(1, 4)):
        out = pa.Table.from_batches(list(codec._decode(iter([b]), Shared)))
        want = [b"abcabcabc", b"", b"d", None, b"abcd", b""]
        assert out.column("data").to_pylist() == [want[i] for i in b.column("id").to_pylist()] and out.num_rows == b.num_rows


def test_epochs(spark):
    s = spark.createDataFrame([(0, 3), (1, 0), (2, 5), (3, 4)], "shard long, samples long")
    plain = pack.epoch_order(s, 2).orderBy("step").collect()
    one = [(k, i) for k, n in ((0, 3), (2, 5), (3, 4)) for i in range(n)]
    assert [(r.epoch, r.shard, r.sample) for r in plain] == [(e, *x) for e in (0, 1) for x in one]
    assert [r.step for r in plain] == list(range(24))
    mixed = [(r.shard, r.sample) for r in pack.epoch_order(s, 2, 42).orderBy("step").collect()]
    assert mixed == [(r.shard, r.sample) for r in pack.epoch_order(s, 2, 42).orderBy("step").collect()]
    assert sorted(mixed[:12]) == one == sorted(mixed[12:]) and len({tuple(one), tuple(mixed[:12]), tuple(mixed[12:])}) == 3
    # a shard's samples stay together
    assert [sum(a[0] != b[0] for a, b in zip(x, x[1:])) for x in (mixed[:12], mixed[12:])] == [2, 2]


def test_surprise_and_segments(spark):
    import math

    d = spark.createDataFrame([(0, "abcabd"), (1, "q"), (2, None)], "doc_id long, text string")
    lm = bytelm.train_lm(d, 3)
    import numpy as np

    h = lm.surprise(np.frombuffer(b"abcabd", np.uint8))
    assert len(h) == 5 and h[0] == pytest.approx(-math.log(3 / 258)) and h[1] == pytest.approx(-math.log(2 / 258))
    ties = spark.createDataFrame([(0, "aaaaaaaa")], "doc_id long, text string")
    tlm = bytelm.train_lm(ties, 2)
    tau = bytelm.threshold(bytelm.surprise_histogram(ties, tlm))
    assert segment.segments(b"aaaaaaaa", tlm, tau) == [b"aaaaaaaa"]
    assert {bytes(r.token): r.freq for r in segment.segment_counts(ties, tlm, tau, 3).collect()} == {b"aaa": 2, b"aa": 1}
    assert segment.segment_pair_counts(ties, tlm, tau, 16).collect()[0].freq == 1
    assert bytelm.threshold(bytelm.surprise_histogram(d.where("doc_id = 1"), lm)) == np.inf


def test_minhash_finds_prefixes(spark):
    grams = [b"abcd", b"abcde", b"abcdef", b"abcdefg", b"abcdefgh", b"zzzz", b"abXd"]
    g = spark.createDataFrame([(i, x) for i, x in enumerate(grams)], "cand_id long, token binary")
    exact = minhash.jaccard_pairs(g, 0.8).collect()
    assert {(r.a, r.b) for r in exact} == {(0, 1), (1, 2), (2, 3), (3, 4)}
    sig = {r.cand_id: r.sig for r in minhash.signatures(g).collect()}
    f = [p * 256 + b for p, b in enumerate(b"abcd")]
    assert sig[0] == [min((a * x + b) % minhash.PRIME for x in f) for a, b in minhash.parameters()]
    rows = minhash.band_rows(minhash.signatures(g))
    assert rows.count() == len(grams) * minhash.BANDS
    pairs = {(r.a, r.b) for r in minhash.candidate_pairs(rows).collect()}
    assert all(r.a < r.b for r in minhash.star_edges(rows).collect()) and (0, 5) not in pairs


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (102, 100), (200, 150), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_independent_sets():
    assert vocab.select_independent([5, 4, 3], [], 2) == [0, 1]
    assert vocab.select_independent([5, 4, 3, 1], [(0, 1), (1, 2)], 4) == [0, 2, 3]
    assert vocab.relaxed_independent_set([1.0, 1.0, 1.0], [(0, 1), (1, 2), (0, 2)]) == [0.5, 0.5, 0.5]
    star = vocab.relaxed_independent_set([5.0, 3.0, 3.0], [(0, 1), (0, 2)])
    assert star == [0.0, 1.0, 1.0]
    assert len(vocab.select_independent([9, 8, 7, 6], [(0, 1)], 2)) == 2


def test_greedy_gain():
    data = b"abcabcabcxy" * 4
    chosen = vocab.greedy_gain(data, [b"abc", b"ab", b"bc", b"xy", b"zz"], 3)
    assert chosen[0] == b"abc" and b"xy" in chosen and b"zz" not in chosen
    # ties go to the smaller bytes
    assert vocab.greedy_gain(b"abcd", [b"cd", b"ab"], 1) == [b"ab"]
    dp = vocab.shortest_costs(data, set(chosen), 16)
    assert dp[-1] == 16


def test_corpus(spark, tiny):
    p = corpus.corpus_prefix(tiny, 5).collect()
    assert {r.doc_id: bytes(r.data) for r in p} == {0: b"abab", 1: b"", 2: b"\xc3"}
    d = spark.createDataFrame([(1, "a<|endoftext|>\n b \n<|endoftext|>  <|endoftext|>c"), (2, "plain")], "doc_id long, text string")
    assert [(r.doc_id, r.document) for r in corpus.split_documents(d).orderBy("doc_id", "part").collect()] == [(1, "a"), (1, "b"), (1, "c"), (2, "plain")]
    s = corpus.split_sections(spark.createDataFrame([(1, "a\n\nb\n\n\nc")], "doc_id long, text string")).orderBy("section_no").collect()
    assert [r.section for r in s] == ["a\n\n", "b\n\n", "\nc"]
    r = running_sum(spark.createDataFrame([(i * 7, i) for i in range(100)], "k long, v long"), "k", "v", block=50).orderBy("k").collect()
    assert [x.before for x in r] == [sum(range(i)) for i in range(100)]


def test_packing_and_batches(spark):
    """Four shards of 140 counting tokens: every token of a whole batch comes once, in order, with its successor."""
    d = spark.createDataFrame([(0, list(range(100))), (1, list(range(100, 300))), (2, []), (3, list(range(300, 560)))], "doc_id long, tokens array<int>")
    p = pack.pack(d, 140)
    pieces = p.orderBy("shard", "first").collect()
    assert [t for r in pieces for t in r.tokens] == list(range(560)) and {r.split for r in pieces if r.shard == 0} == {"val"}
    m = pack.manifest(p)
    assert {r.shard: r.n_tokens for r in m.collect()} == {i: 140 for i in range(4)}
    for ranks in (1, 2):
        rows = pack.rows_of_batches(pack.stream(p, 9999), m, ranks, 4, 8).collect()
        span = ranks * 32
        want = {s * 140 + k for s in range(4) for k in range((139 // span) * span)}
        assert sorted(r.token for r in rows) == sorted(want)
        # the row's target is its successor, but where a document ends and another begins
        assert all(r.target == r.token + 1 or r.token + 1 in (100, 300) for r in rows)
        assert {(r["rank"], r["row"], r["col"]) for r in rows} == {(a, b, c) for a in range(ranks) for b in range(4) for c in range(8)}
    assert pack.check_manifest(m, 2, 4, 32).where("valid").count() == 0
    assert pack.resume(spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 0)], "shard long, sample long"), 1, 1).count() == 2


def test_metrics(spark):
    d = spark.createDataFrame([("en", "ab ab"), ("fr", "é"), ("fr", None)], "lang string, text string")
    t = codec.load_tokenizer(vocab.layout(spark, [b"ab"], 300))
    m = {r.lang: r for r in metrics.evaluate(d, t, ["lang"]).collect()}
    assert (m["en"].n_bytes, m["en"].n_tokens, m["en"].n_words) == (5, 3, 2) and m["en"].coverage == pytest.approx(2 / 3)
    assert m["fr"].n_bytes == 2 and m["fr"].compression == 1.0
    assert metrics.fertility(d, t).first().fertility == pytest.approx(4 / 3)
    assert metrics.encode_speed(TEXT, t) > 0
    x = spark.range(1).select(metrics.loss_to_bpb(F.lit(3.0), F.lit(3.6)).alias("x")).first().x
    assert x == pytest.approx(3.0 / 0.6931471805599453 / 3.6)


def test_run_slices(spark):
    from tokenmill.functions.text import run_slices, split_runs

    assert list(run_slices("aaaaa  bb", 2, 100)) == ["aa", "aa", "a  bb"]
    assert list(run_slices("", 2, 100)) == [] and list(run_slices("abc", 9, 2)) == ["ab", "c"]
    d = spark.createDataFrame([("x" * 7,), (None,)], "t string").select(split_runs(F.col("t"), 3, 100).alias("s")).collect()
    assert [r.s for r in d] == [["xxx", "xxx", "x"], None]


def test_relaxed_sets_against_all_half_integral_points():
    r = random.Random(3)
    for _ in range(25):
        n = r.randint(2, 7)
        weights = [float(r.randint(-2, 9)) for _ in range(n)]
        edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.4]
        allowed = lambda y: all(y[a] + y[b] <= 1 for a, b in edges)  # noqa: E731, B023
        worth = lambda y: sum(w * v for w, v in zip(weights, y, strict=True))  # noqa: E731, B023
        y = vocab.relaxed_independent_set(weights, edges)
        # vertices of the relaxation are half-integral, so the best of these points is the optimum
        assert allowed(y) and worth(y) == pytest.approx(max(worth(p) for p in itertools.product((0.0, 0.5, 1.0), repeat=n) if allowed(p)))


def test_selected_sets_are_independent_and_maximal():
    r = random.Random(4)
    for _ in range(25):
        n = r.randint(2, 9)
        freqs = sorted((r.randint(1, 30) for _ in range(n)), reverse=True)
        edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.3]
        for most in (1, 3, n):
            got = vocab.select_independent(freqs, edges, most)
            assert len(got) <= most and not any(a in got and b in got for a, b in edges)
            if len(got) < most:  # every other candidate has a neighbour among the chosen
                assert all(i in got or any(i in e and (e[0] in got or e[1] in got) for e in edges) for i in range(n))


def all_costs(data, tokens):
    """Fewest pieces of any way to cut data into single bytes and tokens, by trying all."""
    if not data:
        return 0
    return 1 + min(all_costs(data[k:], tokens) for k in range(1, len(data) + 1) if k == 1 or data[:k] in tokens)


def test_costs_against_all_cuts(spark):
    r = random.Random(5)
    for _ in range(30):
        data = bytes(r.choices(b"abc", k=r.randint(0, 11)))
        tokens = {bytes(r.choices(b"abc", k=r.randint(2, 4))) for _ in range(6)}
        got = vocab.shortest_costs(data, tokens, 4)
        assert got.tolist() == [all_costs(data[:i], tokens) for i in range(len(data) + 1)]
    t = codec.load_tokenizer(vocab.layout(spark, [b"ab", b"abc", b"bcd"], 300))
    d = spark.createDataFrame([(0, "abcd"), (1, "abab"), (2, ""), (3, "xbcdabc")], "doc_id long, text string")
    assert {x.doc_id: x.cost for x in codec.with_shortest_cost(d, t).collect()} == {i: all_costs(x.encode(), {b"ab", b"abc", b"bcd"}) for i, x in ((0, "abcd"), (1, "abab"), (2, ""), (3, "xbcdabc"))}


def plain_gain(data, tokens, most):
    """The same choice without a heap: the list is searched and every place compared."""
    at = {t: [i for i in range(len(data)) if data.startswith(t, i)] for t in tokens}
    dp, chosen = list(range(len(data) + 1)), []
    saving = lambda t: sum(max(0, dp[i + len(t)] - dp[i] - 1) for i in at[t])
    known = {t: (-saving(t), 0, t) for t in tokens if at[t]}
    while known and len(chosen) < most:
        worst, stamp, t = min(known.values())
        del known[t]
        if stamp < len(chosen):
            if saving(t) > 0:
                known[t] = (-saving(t), len(chosen), t)
        elif worst == 0:
            break
        else:
            chosen.append(t)
            now = [(i + len(t), dp[i] + 1) for i in at[t]]
            for end, cost in now:
                dp[end] = min(dp[end], cost)
    return chosen


def test_gain_against_a_plain_search():
    r = random.Random(6)
    for _ in range(20):
        data = bytes(r.choices(b"abcd", k=r.randint(1, 120)))
        tokens = sorted({bytes(r.choices(b"abcd", k=r.randint(2, 4))) for _ in range(15)})
        assert vocab.greedy_gain(data, tokens, 6) == plain_gain(data, tokens, 6)
    # where tokens never meet, the choice is that of the most bytes saved
    data = b"abc." * 3 + b"xy." * 4 + b"pqrs." * 5
    assert vocab.greedy_gain(data, [b"abc", b"xy", b"pqrs", b"zz"], 3) == [b"pqrs", b"abc", b"xy"]


def test_metrics_by_language_against_plain_sums(spark):
    r = random.Random(7)
    rows = [(i, None if i == 3 else " ".join(r.choices(["ab", "abc", "é", "x"], k=i % 5)), ["en", "de", None][i % 3]) for i in range(30)]
    t = codec.load_tokenizer(vocab.layout(spark, [b"ab", b"abc", "é".encode()], 300))
    got = {x.lang: x for x in metrics.evaluate(spark.createDataFrame(rows, "doc_id long, text string, lang string"), t, ["lang"]).collect()}
    assert set(got) == {"en", "de", None}
    for lang, x in got.items():
        texts = [y for _, y, z in rows if z == lang and y is not None]
        ids = [k for y in texts for k in t.encode(y)]
        n = (sum(len(y.encode()) for y in texts), sum(len(y.split()) for y in texts), len(ids))
        assert (x.n_bytes, x.n_words, x.n_tokens) == n
        assert (x.compression, x.coverage, x.tokens_per_word) == pytest.approx((n[0] / n[2], sum(k > 255 for k in ids) / n[2], n[2] / n[1]))


def test_occurrences_and_large_conflict_graphs():
    r = random.Random(9)
    data = bytes(r.choices(b"ab\xc3\x00", k=400))
    tokens = [b"a", b"ab", b"aba", b"\xc3\x00", b"\x00\x00", b"zz", b"", b"ab"]
    want = {t: [i for i in range(len(data)) if data.startswith(t, i)] for t in tokens if t}
    assert {t: p.tolist() for t, p in vocab.occurrences(data, tokens).items()} == {t: p for t, p in want.items() if p}
    assert vocab.occurrences(b"", [b"a"]) == {} == vocab.occurrences(b"abc", [])
    # ten thousand candidates in small parts: each pair keeps its better half
    freqs = [20_000 - i for i in range(10_000)]
    assert vocab.select_independent(freqs, [(i, i + 1) for i in range(0, 10_000, 2)], 10_000) == list(range(0, 10_000, 2))


def test_shuffled_documents(spark):
    d = spark.range(200).select(F.col("id").alias("doc_id"))
    order = lambda seed: [x.doc_id for x in corpus.shuffled(d.repartition(3), seed).collect()]
    assert order(1) == order(1) != order(2) and sorted(order(1)) == list(range(200)) != order(1)
