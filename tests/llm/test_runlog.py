import hashlib
import random

import pytest

from tokenmill.llm.repeats import FIRST, keyed
from tokenmill.llm.runlog import RunLog, batches_by_id, substring_dedup
from tokenmill.scratch import MERGE, settings


def brute(rows, window=13):
    first, out = {}, {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        key = float("inf") if i is None else i
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            first[w] = min(first.get(w, key), key)
    for i, words in split:
        key, gone = float("inf") if i is None else i, [False] * len(words)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < key:
                gone[s : s + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed,batches,max_runs", [(1, 1, 4), (2, 2, 4), (3, 5, 2)])
def test_matches_brute_force(spark, seed, batches, max_runs):
    r = random.Random(seed)
    vocabulary = ["the", "of", "né", "a"] + ["".join(r.choices("abcde", k=5)) for _ in range(60)]
    shared = [r.choices(vocabulary, k=r.randint(13, 60)) for _ in range(6)]
    rows = []
    for i in range(90):
        kind = r.random()
        if kind < 0.15:
            words = ["be", "so"][: r.randint(1, 2)] * r.randint(1, 60)
        elif kind < 0.3 and rows:
            words = r.choice(rows)[1].split()
            if words and r.random() < 0.7:
                words[r.randrange(len(words))] = "changed"
        else:
            words = r.choices(vocabulary, k=r.randint(0, 40)) + r.choice(shared) + r.choices(vocabulary, k=r.randint(0, 40))
        rows.append((i * 2, r.choice([" ", "\n", " \t "]).join(words)))
    rows += [(500, ""), (501, None), (502, "  \n"), (None, rows[7][1])]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batches, max_runs).collect()
    assert {x.doc_id: (x.n, x.n_removed, x.kept_sha256) for x in got} == brute(rows)
    assert len(got) == len(rows)


def test_empty_repeated_and_extra_columns(spark):
    schema = "doc_id long, text string, h string, kind int"
    assert substring_dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(3, text, "x", 1), (3, text, "x", 1), (3, text + " more", "x", 1), (4, "zero " + text, None, None)]
    got = substring_dedup(spark.createDataFrame(rows, schema), batches=3, keep=True).collect()
    assert sorted((x.doc_id, x.n_removed) for x in got) == [(3, 0), (3, 0), (3, 0), (4, 20)]
    assert [bytes(x.kept) for x in got if x.doc_id == 4] == [b"zero"]


def test_the_log_merges_stored_runs_and_compacts(spark):
    """Two runs and a new one are joined as they are stored: no shuffle, no sort. Compaction keeps every stretch once."""
    r = random.Random(8)
    words = ["".join(r.choices("abcde", k=5)) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=200)) for _ in range(40)]
    docs = keyed(spark.createDataFrame([(i, texts[i % 30]) for i in range(40)], "doc_id long, text string"))
    log = RunLog(spark, max_runs=2)
    parts = batches_by_id(docs, 4)
    for part in parts[:3]:
        log.add(part)
    assert len(log.runs) == 3 and log.merges == 0
    with settings(spark, MERGE):
        newest = log.runs.pop()
        plan = log._compared(newest[0], FIRST)._jdf.queryExecution().executedPlan().toString()
        log.runs.append(newest)
    assert plan.count("SortMergeJoin") == 4 and "Exchange" not in plan and "Sort [" not in plan, plan
    runs = [x.rows().where(f"kind = {FIRST}").select("h", "digest", "dk").collect() for x, _ in log.runs]
    found = log.add(parts[3])
    assert log.merges == 1 and len(log.runs) == 3
    first = {}
    for x in (row for run in runs for row in run):
        first[x.h, x.digest] = min(x.dk, first.get((x.h, x.digest), x.dk))
    now = [row for x, _ in log.runs[:2] for row in x.rows().where(f"kind = {FIRST}").select("h", "digest", "dk").collect()]
    assert {(x.h, x.digest): x.dk for x in now} == first and sum(n for _, n in log.runs[:2]) == len(now)
    assert {x.dk for rows in found for x in rows.where("kind = 0").collect()} == set(range(30, 40))
    log.close()


def test_the_query_indexes_every_batch_and_compacts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(RunLog, "close", lambda log: seen.append((len(log.runs), log.merges)))
    rows = [(i, " ".join(f"w{j % 17 + i}" for j in range(40))) for i in range(60)]
    assert substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).count() == 60
    assert seen == [(3, 1)]


def test_few_stretches_stay_open_where_only_short_phrases_are_shared(spark):
    """Texts of few words share phrases of four by chance; stretches that are the same in no other way are settled at once."""
    r = random.Random(12)
    rows = [(i, " ".join(f"w{r.randrange(12)}" for _ in range(80))) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(10)]
    log = RunLog(spark)
    dup, new = log.add(keyed(spark.createDataFrame(rows, "doc_id long, text string")))[:2]
    total = log.runs[0][0].rows().count()
    assert new.where("kind = 1").count() < 0.1 * total and dup.count() > 50
    log.close()
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n, x.n_removed, x.kept_sha256) for x in got} == brute(rows)
