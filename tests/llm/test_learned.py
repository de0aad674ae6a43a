import math
import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tokenmill.llm.language import identify, predict, train, windows
from tokenmill.llm.toxicity import LEVEL, WINDOW, reject_toxic, toxicity
from tokenmill.llm.toxicity import fit as toxicity_model

WORDS = {"aa": ["zhu", "xin", "qua", "lok"], "bb": ["the", "and", "ing", "ed"], "cc": ["é", "ñu", "ça", "où"]}


def test_language(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choices(WORDS[lang], k=r.randint(5, 200))), lang, "s"))
    rows += [(9001, None, "aa", "s"), (9002, "", "aa", "s"), (9003, "123 !!", None, "s"), (9004, "the " * 50_000, None, "s"), (None, "zhu xin qua lok", None, "s"), (9001, None, "aa", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(d).collect()
    assert len(got) == len(rows)
    truth = {x[0]: x[2] for x in rows}
    held = [g for g in got if g.held_out and g.lang_pred != "und"]
    assert len(held) > 80 and sum(truth[g.doc_id] == g.lang_pred for g in held) / len(held) > 0.97
    assert {(g.doc_id, g.lang_pred, g.score) for g in got if g.doc_id in (9001, 9002, 9003)} == {(i, "und", 0.0) for i in (9001, 9002, 9003)}
    assert next(g.lang_pred for g in got if g.doc_id == 9004) == "bb"
    assert next(g.lang_pred for g in got if g.doc_id is None) == "aa"
    assert identify(d.limit(0)).count() == 0
    assert {g.lang_pred for g in identify(d.withColumn("lang", d.lang.substr(9, 1)).where("false")).collect()} == set()
    assert windows(b"x" * 257).shape == (2, 256)


def test_toxicity(spark):
    r = random.Random(2)
    usual = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(1200):
        words = r.choices(usual, k=r.randint(20, 200))
        bad = i % 5 == 1
        for _ in range(r.randint(2, 6) if bad else 0):
            words.insert(r.randint(0, len(words)), r.choice(["rotter", "vilewretch", "scoundrel", "blackguard"]))
        docs.append((i, " ".join(words)))
        if r.random() < 0.8:
            labels.append((i, int(bad)))
    labels += [(labels[0][0], labels[0][1]), (None, 1), (77_777, None)]
    docs += [(5001, None), (5002, ""), (None, "scoundrel rotter"), (5003, docs[0][1] * 300), (5002, "")]
    d = spark.createDataFrame([(*x, 0.1) for x in docs], "doc_id long, text string, toxicity double")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity(d, y).collect()
    assert len(got) == len(docs) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    held = [g for g in got if g.held_out and g.doc_id < 1200]
    assert len(held) > 100 and sum(g.predicted == (g.doc_id % 5 == 1) for g in held) / len(held) > 0.97
    assert {g.predicted for g in got if g.doc_id in (5001, 5002, 5003)} == {0}
    assert toxicity(d.limit(0), y).count() == 0
    stays = reject_toxic(d.withColumnRenamed("toxicity", "__score").withColumn("score", F.lit("x")).withColumn("a.b", F.lit(1)), y)
    assert stays.columns == ["doc_id", "text", "__score", "score", "a.b"]
    kept = [x.doc_id for x in stays.collect()]
    assert kept.count(5002) == 2 and 5001 in kept and None not in kept and len({i for i in kept if i and i < 1200 and i % 5 == 1}) <= 8
    assert reject_toxic(d.limit(0), y).count() == 0 and reject_toxic(d, y.limit(0)).count() == len(docs)
    assert {g.score for g in toxicity(d.limit(5), y.limit(0)).collect()} == {0.0}


def test_language_matches_the_plain_network(spark):
    """Predictions from pair tables in blocks against filter by filter responses, one text at a time."""
    r = random.Random(3)
    texts = [" ".join(r.choices(WORDS[r.choice(list(WORDS))], k=r.choice([1, 5, 60, 400]))) for _ in range(80)]
    rows = [(i, t, next(k for k, w in WORDS.items() if t.split()[0] in w)) for i, t in enumerate(texts)]
    net = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    got = {x.doc_id: (x.lang_pred, x.score) for x in predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), net).collect()}
    for i, text, _ in rows:
        data = text.encode()
        x = windows(data)
        z = np.maximum(net.pooled(x)[0], 0) @ net.dense + net.bias
        logs = z - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) - z.max(1, keepdims=True)
        size = np.array([x.shape[1]] * (len(x) - 1) + [len(data) - x.shape[1] * (len(x) - 1)])
        mean = (logs * size[:, None]).sum(0) / len(data)
        p = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert got[i][0] == net.langs[int(p.argmax())] and abs(got[i][1] - p.max()) < 1e-3


def test_toxicity_matches_windows_one_by_one():
    """Scores against a compressor made anew for every window, and the curve written out."""
    r = random.Random(4)
    usual = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(200)]
    text = lambda bad: " ".join(r.choices(usual, k=r.randint(3, 60)) + r.choices(["vilewretch", "scoundrel"], k=bad * 3)).encode()
    model = toxicity_model([text(True) for _ in range(60)], [text(False) for _ in range(120)])
    assert model.toxic
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, window_log=18, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def size(content, data):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(data))

    for data in [text(k % 2 == 0).upper() for k in range(12)] + [b"", None, b"scoundrel"]:
        words, gains = (data or b"").lower().split(), []
        for i in range(0, len(words), WINDOW):
            w = model.ordinary[-40:] + b" " + b"  ".join(words[i : i + WINDOW]) + b" "
            gains.append(size(model.ordinary, w) - size(model.toxic + model.ordinary, w))
        up = sorted((g for g in gains if g > 0), reverse=True) + [0, 0]
        x = [1, up[0], up[1], math.log1p(sum(up)), math.log1p(sum(g >= 3 for g in up)), math.log1p(len(gains))]
        z = sum(a * b for a, b in zip(x, model.weights, strict=True))
        assert abs(model.score(model.features(data)) - 1 / (1 + math.exp(-max(z, -700)))) < 1e-9
