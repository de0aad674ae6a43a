import hashlib
import random

import pytest

from tokenmill.llm.automaton import contamination, cut, decontaminate, item_words


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        words = item_words(text)
        hit, ids = set(), set()
        for item, t in items:
            w = item_words(t)
            size = min(n, len(w))
            grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
            for p in range(len(words) - size + 1):
                if size and item is not None and tuple(words[p : p + size]) in grams:
                    hit |= set(range(p, p + size))
                    ids.add(item)
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(ids), sha, bool(hit)))
    return out


@pytest.mark.parametrize("seed,block", [(1, 200_000), (2, 30)])
def test_matches_brute_force(spark, seed, block):
    r = random.Random(seed)
    vocabulary = ["a", "b", "é", "x1", "The"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12) if i != 3]
    items += [(3, None), (None, "a b"), (40, items[5][1]), (41, "..."), (42, "é b b")]
    items = [x for x in items if len(item_words(x[1])) != 1 or r.random() < 0.2]
    docs = []
    for i in range(60):
        words = r.choices(vocabulary + ["other"] * 3, k=r.randint(0, 60))
        if r.random() < 0.5:
            words[3:3] = (r.choice(items)[1] or "").split()
        docs.append((i, r.choice([" ", ", ", "-"]).join(words)))
    docs += [(None, "a b a"), (61, None), (62, ""), (62, ""), (63, "!!!")]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, items), key=str)


def test_cleaning_and_empty_tables(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Some words before. {item}, and quite a lot of other words that come after it here.", "x"), (2, item, None), (3, None, "x"), (4, "clean text, left alone", "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    items = spark.createDataFrame([(7, item.upper())], "item_id long, text string")
    got = {x.doc_id: x.text for x in decontaminate(d, items).collect()}
    assert got == {1: "Some words before. , and quite a lot of other words that come after it here.", 3: None, 4: "clean text, left alone"}
    assert decontaminate(d, items.limit(0)).count() == 4
    assert contamination(d.limit(0), items).count() == 0
    assert cut("é a b".encode(), [(0, 1), (2, 3)]) == b" a "


def test_items_without_an_id_are_cut(spark):
    long, short = "one two three four five six seven eight nine ten eleven", "red green blue"
    rest = "and quite a lot of other words that come after it here"
    d = spark.createDataFrame([(1, f"{long} {rest}"), (2, f"{short} {rest}"), (3, rest)], "doc_id long, text string")
    items = spark.createDataFrame([(None, long), (None, short), (5, "unrelated words")], "item_id long, text string")
    assert {x.doc_id: x.text.strip() for x in decontaminate(d, items, max_coverage=0.9).collect()} == {1: rest, 2: rest, 3: rest}


@pytest.mark.parametrize("block", [6, 200_000])
def test_stage_with_clashing_columns_and_empty_tables(spark, block):
    schema = "doc_id long, text string, n_words timestamp, `spans` string, __items int, `a.b` int"
    item = "one two three four five six seven eight nine ten eleven"
    more = (None, "s", 7, 8)
    rows = [(1, f"Well, {item}! and then a lot of other words stay here, all of them, as they are", *more), (2, None, *more), (2, "", *more), (2, "", *more), (None, item, *more)]
    docs, items = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, item), (2, "other things"), (None, None)], "item_id long, text string")
    got = decontaminate(docs, items, block_words=block)
    assert got.dtypes == docs.dtypes
    got = got.collect()
    assert sorted((str(x.doc_id), x.text, x["spans"], x["a.b"]) for x in got if x.text) == [("1", "Well, ! and then a lot of other words stay here, all of them, as they are", "s", 8)]
    assert sorted(str(x.text) for x in got if x.doc_id == 2) == ["", "", "None"] and len(got) == 4
    assert decontaminate(docs.limit(0), items).count() == 0 and decontaminate(docs, items.limit(0)).count() == 5
