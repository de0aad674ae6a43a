import hashlib
import math
import random

import pytest

from tokenmill.llm.mixing import mix


def brute_targets(sizes, ratios=(5, 2, 1), total=1.5, cap=2.0):
    """Share by weight; cut what is over the cap; share that anew, until nothing is over."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: ratios[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, total * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def brute(rows, weights):
    d = [(i, len((t or "").split()), s) for i, t, s in rows]
    sizes = {}
    for _, n, s in d:
        sizes[s] = sizes.get(s, 0) + n
    target, out = brute_targets(sizes), []
    for s in sizes:

        def key(x):
            u = (int(hashlib.md5(f"mix-1:{'' if x[0] is None else x[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return (-math.log(u) / weights.get(x[0], 1.0), -1 if x[0] is None else x[0], x[1])

        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        left = math.floor(target[s] - epochs * sizes[s])
        for i, n, _ in sorted((x for x in d if x[2] == s), key=key):
            part = min(n, max(0, left))
            left -= part
            out.append((i, n, sizes[s], target[s], epochs * n + part))
    return out


@pytest.mark.parametrize("seed,broadcast", [(1, True), (2, False)])
def test_matches_brute_force(spark, monkeypatch, seed, broadcast):
    if not broadcast:
        monkeypatch.setattr("tokenmill.llm.mixing.BROADCAST_ROWS", 1)
    r = random.Random(seed)
    sources = ["b", "a", "é", "z", None, "tiny", "empty"]
    rows = []
    for i in range(300):
        s = r.choices(sources, [9, 3, 3, 2, 2, 1, 0])[0]
        rows.append((i, " \t".join(["w"] * r.randint(0, 3 if s == "tiny" else 40)), s))
    rows += [(900, None, "empty"), (901, "", "empty"), (None, "a b c", "a"), (None, "a b c", "a"), (5, rows[5][1], rows[5][2]), (902, "x " * 50_000, "b")]
    weights = {i: r.choice([0.5, 2.0]) for i in range(0, 300, 3)}
    d = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "doc_id long, text string, source string, n int, weight double")
    q = spark.createDataFrame([*weights.items(), (1, None), (2, -1.0), (None, 2.0)], "doc_id long, weight double")
    got = mix(d, q).collect()
    again = mix(d.repartition(5), q).collect()
    row = lambda x: (x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken)
    want = [(a, b, c, round(t, 6), k) for a, b, c, t, k in brute(rows, weights)]
    assert sorted(map(row, got), key=str) == sorted(want, key=str) == sorted(map(row, again), key=str)
    assert all(x.taken <= 2 * x.size for x in got)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert [x.taken for x in mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [0]
