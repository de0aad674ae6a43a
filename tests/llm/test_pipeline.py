import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    """Planted cases: a copy, a near copy, a shared passage, a benchmark passage and toxic documents."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(3000)]
    bad = ["rotter", "vilewretch", "scoundrel", "blackguard"]
    item = " ".join(r.choices(words, k=30))
    passage = " ".join(r.choices(words, k=60))
    docs, labels = [], []
    for i in range(400):
        w = r.choices(words, k=r.randint(80, 200))
        if i % 4 == 1:
            for _ in range(8):
                w.insert(r.randint(0, len(w)), r.choice(bad))
        labels.append((i, 1, int(i % 4 == 1)))
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
    near = docs[8][1].split()
    near[40] = "altered"
    docs += [(500, docs[4][1], "en", "s0", 0), (501, " ".join(near), "en", "s0", 0)]
    docs += [(502 + k, " ".join(r.choices(words, k=90)) + " " + passage + " " + " ".join(r.choices(words, k=90)), "en", "s1", 0) for k in range(2)]
    docs += [(510, " ".join(r.choices(words, k=90)) + " " + item, "en", "s2", 0), (511, item, "en", "s2", 0), (512, None, None, None, None), (513, "", "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = f(spark, now, str(tmp_path))
        assert out.columns == now.columns and out.dtypes == now.dtypes
        out.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append({x.doc_id: x.text for x in now.collect()})
    toxic, clean = {i for i in range(400) if i % 4 == 1}, {i for i in range(400) if i % 4 != 1}
    assert len(toxic & set(seen[0])) <= 2 and len(clean - set(seen[0])) <= 3
    assert 500 not in seen[1] and 501 not in seen[1] and {4, 8, 502, 503} <= set(seen[1])
    assert passage in seen[2][502] and passage not in seen[2][503] and seen[2][4] == docs[4][1]
    assert item in seen[2][510] and item not in seen[3][510] and 511 not in seen[3]
    assert 512 in seen[3] and seen[3][512] is None
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in mixed} == set(seen[3]) and all(0 <= x.taken <= 2 * x.size for x in mixed)


def test_stages_of_repeated_rows_clashing_names_and_empty_tables(spark, tmp_path):
    """Columns named like the operators' own work columns pass through; repeated rows leave one; empty tables give empty stages."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(500)]
    names = ["spans", "items", "n_words", "fp", "bands", "root", "block", "h0", "h1", "state", "score", "letters", "before", "shard", "h", "sub", "size", "key", "first", "toxic"]
    docs = [(i, " ".join(r.choices(words, k=60)), "en", "s", 0, *[f"{n}{i}" for n in names]) for i in range(40)]
    docs += [docs[3], docs[3], (50, None, None, None, None, *[None] * len(names)), (50, None, None, None, None, *[None] * len(names)), (51, "", "en", "s", 0, *[""] * len(names)), (52, "word " * 30_000, "en", "s", 0, *["x"] * len(names))]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    for folder, rows in (("some", docs), ("none", [])):
        path = str(tmp_path / folder)
        spark.createDataFrame(rows, kinds).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(i, 1, i % 2) for i in range(40)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(1, " ".join(docs[7][1].split()[:20])), (None, None)] if rows else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        now = spark.read.parquet(f"{path}/documents.parquet")
        for k, (name, f) in enumerate(corpus_pipeline.STAGES[1:-1]):
            out = f(spark, now, path)
            assert out.dtypes == now.dtypes, name
            out.write.parquet(f"{path}/stage{k}")
            now = spark.read.parquet(f"{path}/stage{k}")
        left = {x.doc_id: x for x in now.collect()}
        assert now.count() == len(left)
        if rows:
            assert set(range(40)) <= set(left) and len({50, 51} & set(left)) == 1
            assert all(left[i][n] == f"{n}{i}" for i in range(40) for n in names)
            assert len(left[7].text.split()) == 40 and left[3].text == docs[3][1]
        else:
            assert not left and corpus_pipeline.run(spark, path).count() == 0
