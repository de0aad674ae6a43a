import random
import statistics

import pytest
from pyspark.sql import functions as F

from tokenmill.functions import numeric, schedules
from tokenmill.operators import choice, logs, pack, prefix, trainstats
from tokenmill.operators.corpus import corpus_prefix
from tokenmill.operators.prefix import running_sum
from tokenmill.sources import binfmt, readers
from tokenmill.streaming.monitor import score_stream

LOG = ["val loss 9.9", "step 1/9 | train loss 5.0 | x", "val loss 4.5", "val loss 4.4", "step 2/9 | train loss 4.0", "noise", "step 3/9 | train loss 3.5", "val loss 3.0", "step 4/9 | train loss nan", "step 5/9 | train loss 2.0"]


@pytest.fixture(scope="module")
def rows(spark):
    return logs.parsed(spark.createDataFrame([("r", i, x) for i, x in enumerate(LOG)], "run string, line_no long, line string"))


def test_val_curve_and_records(rows):
    assert [(r.step, r.val_loss) for r in logs.val_curve(rows).orderBy("line_no").collect()] == [(1, 4.5), (1, 4.4), (3, 3.0)]
    got = [(r.step, r.train_loss, r.val_loss) for r in logs.records(rows).orderBy("ordinal").collect()]
    assert got == [(1, 5.0, 4.5), (2, 4.0, None), (3, 3.5, 3.0)]
    assert logs.final_val(logs.val_curve(rows)).first().final_val == 3.0


def test_targets(spark, rows):
    r = logs.records(rows)
    hit = logs.reached(r, spark.createDataFrame([("r", 4.6)], "run string, target double")).first()
    miss = logs.reached(r, spark.createDataFrame([("r", 1.0)], "run string, target double")).first()
    assert (hit.step, hit.hit) == (1, True) and (miss.step, miss.hit) == (3, False)
    near = logs.nearest(r, spark.createDataFrame([(2,)], "at long")).first()
    assert near.step == 1


def test_streams_and_gates(spark):
    lines = ["s:10 tel:3.4", "s:10 trl:3.5 lr:0.01", "s:20 trl:3.0", "s:10 trl:9.0", "junk"]
    v = logs.stream_values(spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "run string, line_no long, line string"))
    assert {(r.stream, r.step, r.value) for r in v.collect()} == {("tel", 10, 3.4), ("trl", 10, 9.0), ("trl", 20, 3.0), ("lr", 10, 0.01)}
    f = spark.createDataFrame([(0, 1.0), (1, 2.2), (2, 5.0)], "idx int, value double")
    g = spark.createDataFrame([(0, 1.005), (1, 2.0), (3, 1.0)], "idx int, value double")
    assert {r.idx: r.ok for r in logs.percent_gate(f, g, 1.0).collect()} == {0: True, 1: False, 2: False, 3: False}
    p = spark.createDataFrame([("a/DONE_00000100",), ("a/DONE_00000200",), ("a/model_999",)], "path string")
    assert logs.highest_done(p).first().max_step == 200


def test_zscores(spark):
    r = random.Random(1)
    values = [r.uniform(-1, 1) for _ in range(256)] + [10.0]
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("c", i, 1.0) for i in range(140)], "s string, i long, v double")
    z = {(x.s, x.i): x.z for x in trainstats.zscores(d, ["s"], "i", "v").collect()}
    assert all(z["a", i] is None for i in range(128)) and all(abs(z["a", i]) < 3 for i in range(128, 256)) and z["a", 256] > 5
    last = values[-128:]
    assert z["a", 256] == pytest.approx((10 - statistics.fmean(last)) / statistics.pstdev(last))
    assert z["c", 139] == 0.0


def test_means(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(30)], "s string, i long, v double")
    e, want = {r.i: r.ema for r in trainstats.ema(d, ["s"], "i", "v").collect()}, 0.0
    for k in range(30):
        want = 0.95 * want + 0.05 * k
        assert e[k] == pytest.approx(want / (1 - 0.95 ** (k + 1)))
    m = {r.i: r.smooth for r in trainstats.moving_average(d, ["s"], "i", "v", 2).collect()}
    assert m[0] == pytest.approx((0 + 0 + 0 + 1 + 2) / 5) and m[15] == pytest.approx(15.0) and m[29] == pytest.approx((27 + 28 + 29 * 3) / 5)


def test_overlapping_blocks_change_nothing(spark, monkeypatch):
    """Blocks far smaller than a partition, sparse and negative keys, null partitions."""
    r = random.Random(8)
    keys = r.sample(range(-(10**12), 10**12), 500)
    rows = [(None if i % 3 == 0 else "a", k, r.uniform(-1, 1)) for i, k in enumerate(keys)]
    d = spark.createDataFrame(rows, "s string, i long, v double")
    for f in ("numbered", "overlapping"):
        whole = getattr(prefix, f)
        monkeypatch.setattr(trainstats, f, lambda *a, whole=whole: whole(*a, block=16))
    z = {x.i: x.z for x in trainstats.zscores(d, ["s"], "i", "v", 5).collect()}
    m = {x.i: x.smooth for x in trainstats.moving_average(d, ["s"], "i", "v", 3).collect()}
    assert len(z) == len(m) == 500
    for s in (None, "a"):
        part = sorted((k, v) for p, k, v in rows if p == s)
        v = [x for _, x in part]
        edged = [v[0]] * 3 + v + [v[-1]] * 3
        for n, (k, x) in enumerate(part):
            assert m[k] == pytest.approx(sum(edged[n : n + 7]) / 7)
            last = v[max(0, n - 4) : n + 1]
            assert z[k] is None if n < 5 else z[k] == pytest.approx((x - statistics.fmean(last)) / statistics.pstdev(last))
    assert trainstats.zscores(d.limit(0), ["s"], "i", "v").count() == 0


def test_exact_exponential_means(spark):
    r = random.Random(2)
    # the first value is so large that its rest is seen for thousands of rows
    rows = [(p, i, 1e60 if i == 0 else r.uniform(-1, 1) if i % 7 else None) for p, n in (("a", 3_000), ("b", 1), (None, 700)) for i in range(n)]
    d = spark.createDataFrame(rows, "s string, i long, v double")
    for decay in (0.95, 0.5, 0.01):
        got = {(x.s, x.i): x.e for x in trainstats.ema(d, ["s"], "i", "v", decay, "e").collect()}
        assert len(got) == len(rows)
        state = {}
        for p, i, v in rows:
            state[p] = state.get(p, 0.0) * decay + (1 - decay) * (v or 0.0)
            assert got[p, i] == pytest.approx(state[p] / (1 - decay ** (i + 1)), rel=1e-9, abs=1e-12)


def test_kernel_passes(spark):
    names = ["encoder_forward(int)", "void layernorm_forward<float>(x)", "ampere_bf16_s16816gemm_128", "layernorm", "matmul", "fused_classifier_kernel5(a)", "gemm_a", "gemm_b", "layernorm_backward", "void attention_backward(b)", "encoder_backward", "cast", "adamw_kernel3", "global_norm"]
    d = spark.createDataFrame([(i, n, 2.0, 3.0) for i, n in enumerate(names)], "i int, kernel string, time_ms double, read_gb double")
    got = trainstats.kernel_passes(d, "i", 12).orderBy("i").collect()
    assert [r.phase for r in got] == ["enc", "fwd", "fwd", "cls", "cls", "cls", "cls", "cls", "cls", "bwd", "enc", "init", "opt", "opt"]
    assert [r.times for r in got] == [1, 12, 12, 1, 1, 1, 1, 1, 1, 12, 1, 0, 1, 1]
    assert [r.time_ms for r in got] == [2.0, 24.0, 24.0, *[2.0] * 6, 24.0, *[2.0] * 4]
    assert [r.name for r in got][:3] == ["encoder_forward", "layernorm_forward", "ampere_bf16"] and got[9].name == "attention_backward"
    assert {r.phase for r in trainstats.kernel_passes(d.where("i < 3"), "i").collect()} == {"enc", "fwd"}


def test_choices(spark):
    ex = spark.createDataFrame([(0, 1, [1, 2], [[3], [4, 5], [6], [7]]), (1, 0, [9], [[1], [1], [2], [2]])], "example_id long, label int, context array<int>, endings array<array<int>>")
    r = choice.render(ex)
    x = r.where("example_id = 0 and choice = 1").first()
    assert x.tokens == [1, 2, 4, 5] and x.mask == [0, 0, 1, 1] and x.targets == [2, 4, 5] and x.target_mask == [0, 1, 1]
    assert r.where("example_id = 0 and choice = 0").first().tokens == [1, 2, 3, 0]
    p = choice.predictions(choice.choice_losses(r.withColumn("losses", F.transform("targets", lambda t: F.lit(1.0)))))
    got = {q.example_id: (q.pred, q.pred_norm) for q in p.collect()}
    assert got == {0: (0, 0), 1: (0, 0)}
    assert choice.accuracy(p).first().acc == 0.5
    streams = [s.ints for s in choice.eval_stream(ex).orderBy("example_id").collect()]
    back = binfmt.eval_examples(binfmt.eval_bytes(streams))
    assert back[0] == {"example_id": 0, "label": 1, "context": [1, 2], "endings": [[3], [4, 5], [6], [7]]} and len(back) == 2


def test_generators(spark):
    g = numeric.MersenneTwister(137)
    # known outputs of the generator for this seed
    assert [g.next32() for _ in range(5)] == [4053805790, 2173880614, 380293709, 1237255315, 2986595568]
    assert sorted(numeric.MersenneTwister(42).permutation(50)) == list(range(50))
    s = 1
    s ^= s >> 12
    s = (s ^ s << 25) & 2**64 - 1
    s ^= s >> 27
    state, value = numeric.xorshift_star(F.col("id") + 1)
    r = spark.range(1).select(state.alias("s"), value.alias("v")).first()
    assert r.s & 2**64 - 1 == s and r.v == (s * 0x2545F4914F6CDD1D & 2**64 - 1) >> 32
    coin = spark.range(1).select(numeric.unit_float(value).alias("c")).first().c
    assert coin == (r.v >> 8) / 2**24 and 0 <= coin < 1


def test_schedules(spark):
    f = lambda c: spark.range(1001).select(c.alias("x")).collect()
    cos = [r.x for r in f(schedules.cosine(F.col("id"), 1.0, 10, 1000, 0.1))]
    assert cos[0] == pytest.approx(0.1) and cos[9] == 1.0 and cos[1000] == pytest.approx(0.1) and cos[505] == pytest.approx(0.55)
    w = [r.x for r in f(schedules.wsd(F.col("id"), 1.0, 0, 1000))]
    assert w[799] == 1.0 and w[1000] == pytest.approx(0.0) and w[850] == pytest.approx(0.5)
    assert f(schedules.by_name(F.lit("none"), F.col("id"), 1.0, 0, 1000))[0].x is None


def test_files(spark, tmp_path):
    for size in (50_257, 100_000):
        data = binfmt.shard_bytes(list(range(1000)), size)
        assert binfmt.shard_tokens(data).tolist() == list(range(1000)) and len(data) == 1024 + 1000 * (2 if size < 65_536 else 4)
    with pytest.raises(ValueError):
        binfmt.shard_tokens(binfmt.shard_bytes([1, 2], 300)[:-2])
    v = spark.createDataFrame([(0, b"a", "byte"), (1, b"bc", "token"), (2, b"<|endoftext|>", "eot")], "token_id int, token binary, kind string")
    binfmt.write_vocab(v, str(tmp_path / "v.bin"))
    assert [(r.token_id, bytes(r.token), r.kind) for r in binfmt.read_vocab(spark, str(tmp_path / "v.bin")).orderBy("token_id").collect()] == [(0, b"a", "byte"), (1, b"bc", "token"), (2, b"<|endoftext|>", "eot")]
    p = spark.createDataFrame([(0, "val", 0, [1, 2]), (0, "val", 2, [3]), (1, "train", 0, [4])], "shard long, split string, first long, tokens array<int>")
    w = binfmt.write_shards(p, str(tmp_path / "s"), 300)
    assert {r.shard: r.n_tokens for r in w.collect()} == {0: 3, 1: 1}
    assert [r.token for r in binfmt.read_shards(spark, str(tmp_path / "s/*.bin")).orderBy("path", "pos").collect()] in ([1, 2, 3, 4], [4, 1, 2, 3])
    assert {r.n_tokens for r in binfmt.peek_shards(spark, str(tmp_path / "s/*.bin")).collect()} == {1, 3}


def test_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\n<|endoftext|>\n two <|endoftext|>  \n")
    assert sorted(r.document for r in readers.text_shards(spark, str(tmp_path / "t.txt")).collect()) == ["one", "two"]
    (tmp_path / "m.csv").write_text('"Q, one?",a,b,c,d,C\n')
    assert readers.mmlu(spark, str(tmp_path / "m.csv")).first().label == 2
    (tmp_path / "h.jsonl").write_text('{"ind": 3, "ctx": "x", "label": 1, "endings": ["a", "b"]}\n')
    assert readers.hellaswag(spark, str(tmp_path / "h.jsonl")).first().endings == ["a", "b"]
    (tmp_path / "s.json").write_text('[{"story": " once "}, {"story": "two"}]')
    assert sorted(r.text for r in readers.story_shards(spark, str(tmp_path / "s.json")).collect()) == ["once", "two"]
    (tmp_path / "r.json").write_text('{"results": {"arc": {"acc": 0.5, "x": 1.0}}}')
    assert readers.harness(spark, str(tmp_path / "r.json"), "acc").first().value == 0.5


def test_stream(spark, tmp_path):
    d = spark.createDataFrame([("a", i, float(i % 7)) for i in range(200)], "stream string, step long, value double")
    d.where("step < 100").write.parquet(str(tmp_path / "in"))
    d.where("step >= 100").write.mode("append").parquet(str(tmp_path / "in"))
    q = score_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.step: (r.z, r.ema) for r in spark.table("scored").collect()}
    z = {r.step: r.z for r in trainstats.zscores(d, ["stream"], "step", "value").collect()}
    assert len(got) == 200 and got[127][0] is None and got[199][0] == pytest.approx(z[199])


def test_both_trainers_lines(spark):
    lines = ["step    1/10 | loss 7.25 (+1.00z)| norm 1.0", "val loss 5.5", "step 2/10 | train loss 6.5 | norm 2", "step 3/10 | val loss 9.0", "loss 4"]
    rows = logs.parsed(spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "run string, line_no long, line string"))
    assert [(r.step, r.train_loss, r.val_loss) for r in rows.orderBy("line_no").collect()] == [(1, 7.25, None), (None, None, 5.5), (2, 6.5, None), (None, None, 9.0)]


def test_profile_of_several_files(spark, tmp_path):
    """Headings of every file go; each number is in its column."""
    for k in range(2):
        head = [",".join(f"h{i}" for i in range(18)), ",".join("u" for _ in range(18)), ""]
        rows = [",".join("k" if i == 4 else str(i + 100 * j) for i in range(18)) for j in range(3)]
        (tmp_path / f"p{k}.csv").write_text("\n".join(head + rows))
    got = readers.profile(spark, str(tmp_path / "*.csv")).collect()
    want = {"read_gb": 11, "write_gb": 12, "time_ms": 13, "l2_read": 14, "l2_write": 15, "tensor_pct": 16, "instructions": 17}
    assert len(got) == 6 and {x.kernel for x in got} == {"k"}
    assert sorted(x.asDict()["tensor_pct"] for x in got) == [16, 16, 116, 116, 216, 216] and all(x[n] % 100 == i for x in got for n, i in want.items())


def test_running_sums_of_repeated_null_and_sparse_keys(spark):
    keys = [5, 5, None, -(2**62), 2**62, 7, None, 0]
    d = spark.createDataFrame([(k, 10) for k in keys], "k long, v long")
    got = [(r.k, r.before) for r in running_sum(d, "k", "v", block=2).collect()]
    assert sorted(b for _, b in got) == [10 * i for i in range(8)]
    assert dict((k, b) for k, b in got if k not in (5, None)) == {-(2**62): 0, 0: 10, 7: 40, 2**62: 50} and {b for k, b in got if k is None} == {60, 70}
    assert running_sum(d.limit(0), "k", "v").count() == 0
    docs = spark.createDataFrame([(1, "abc"), (1, "de"), (None, "fgh"), (2, "i")], "doc_id long, text string")
    got = sorted((bytes(r.data) for r in corpus_prefix(docs, 8).collect()), key=len)
    assert sorted(got) == [b"abc", b"de", b"fg", b"i"]
    packed = pack.pack(spark.createDataFrame([(1, [1, 2, 3]), (1, [4]), (None, [5, 6])], "doc_id long, tokens array<int>"), 4)
    assert sorted((x.shard, x.first, len(x.tokens)) for x in packed.collect())[-1] == (1, 0, 2) and sum(len(x.tokens) for x in packed.collect()) == 6


def test_metric_lines_and_logs(spark, tmp_path):
    rows = [(2, 3.5, 0.1, 1.25, None, None), (1, 4.25, 0.0002, 9.999, 5.0, None), (3, None, None, None, None, 0.25), (4, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "step int, train_loss double, lr double, norm double, val_loss double, eval double")
    want = [(1, "s:1 tel:5.0000"), (1, "s:1 trl:4.2500 lr:0.000200 norm:10.00"), (2, "s:2 trl:3.5000 lr:0.100000 norm:1.25"), (3, "s:3 eval:0.2500")]
    assert sorted(tuple(r) for r in logs.metric_lines(d).collect()) == want
    path = str(tmp_path / "log")
    logs.append_metrics(d.where("step < 3"), path)
    logs.append_metrics(d.where("step = 3"), path)
    read = lambda: sorted(r.value for r in spark.read.text(path).collect())
    assert read() == [x for _, x in want]
    logs.append_metrics(d.where("step = 3"), path, fresh=True)
    assert read() == ["s:3 eval:0.2500"]


def test_questions_with_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"Say ""a, b"".\nThen?",x,"y ""z""",u,v,C\nplain,1,2,3,4,A\n')
    got = sorted((r.question, r.b, r.answer, r.label) for r in readers.mmlu(spark, str(tmp_path / "q.csv")).collect())
    assert got == [('Say "a, b".\nThen?', 'y "z"', "C", 2), ("plain", "2", "A", 0)]


def test_json_results(spark, tmp_path):
    path = str(tmp_path / "results")
    readers.write_json(spark.createDataFrame([({"t": {"acc": 0.5}, "u": {"other": 1.0}},)], "results map<string, map<string, double>>"), path)
    assert [tuple(r) for r in readers.harness(spark, path, "acc", lines=True).collect()] == [("t", 0.5)]


def test_pieces_of_a_shard_are_written_in_order(spark, tmp_path):
    d = spark.createDataFrame([(1, "train", 3, [7, 8]), (1, "train", 0, [70_000, 5, 6]), (0, "val", 0, [1])], "shard long, split string, first long, tokens array<int>")
    n = {r.shard: r.n_tokens for r in binfmt.write_shards(d, str(tmp_path), 100_000).collect()}
    assert n == {0: 1, 1: 5}
    assert binfmt.shard_tokens((tmp_path / "tokens_train_000001.bin").read_bytes()).tolist() == [70_000, 5, 6, 7, 8]
    s = [(r.ordinal, r.path[-20:], r.before) for r in binfmt.sorted_shards(spark, str(tmp_path / "*.bin")).orderBy("ordinal").collect()]
    assert [x[0] for x in s] == [0, 1] and [x[2] for x in s] == [0, 5] and s[0][1].endswith("train_000001.bin")
