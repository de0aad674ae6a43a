import numpy as np
import pytest

from tokenmill.llm import vectors
from tokenmill.llm.vectors import search


def brute(rows, k=10):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i)
            out[i] = d[:k]
    return out


@pytest.mark.parametrize("n,small", [(3000, False), (3000, True), (7, False)])
def test_recall_and_ties(spark, monkeypatch, n, small):
    if small:
        monkeypatch.setattr(vectors, "CANDIDATES", 100)
        monkeypatch.setattr(vectors, "QUERIES", 3)
    r = np.random.default_rng(1)
    x = r.normal(size=(n, 8)).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are one vector
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(10_000, None), (10_100, [0.0] * 8), (10_200, [float("nan")] + [1.0] * 7), (10_300, [1.0, None] + [1.0] * 6), (10_400, [1.0] * 3), (None, [1.0] * 8), (10_500, [])]
    got = search(spark.createDataFrame([(*t, 1.0) for t in rows], "vec_id long, embedding array<float>, score double").repartition(3)).collect()
    want, found = brute(rows), {}
    for g in got:
        found.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    assert set(found) == set(want)
    hits = total = 0
    for q, near in want.items():
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {j for _, j in near})
        total += len(near)
    assert hits / total >= 0.9
    assert [v for _, v, _ in sorted(found[0])] == [j for _, j in want[0]]


def test_empty(spark):
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert search(spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_probes_go_on_until_lists_hold_enough(spark, monkeypatch):
    """20 lists of three vectors, of which one is probed."""
    rows = [(i, [float(i // 3 + 1), i % 3 / 10, 0.0, 1.0]) for i in range(60)] + [(0, [1.0, 0.0, 0.0, 1.0])] * 2
    centroids = np.array([[c + 1, 0.1, 0, 1] for c in range(20)], np.float32)
    monkeypatch.setattr(vectors, "fit", lambda sample, total: vectors.Index(centroids, np.eye(4, dtype=np.float32), 1))
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [g.query_id for g in got] == [0] * 10 and {1, 2, 3, 4, 5} <= {g.vec_id for g in got}


def grouped(n=6000, dim=64, groups=60, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    return (centres[r.integers(0, groups, n)] + 0.25 * r.normal(size=(n, dim))).astype(np.float32)


def test_most_candidates_are_abandoned():
    """With the bound of the nearest list: recall, share of the lists, and components read."""
    x = grouped()
    ids = np.arange(len(x))
    index = vectors.fit(x, len(x))
    assert index.probe <= len(index.centroids) / 3
    of, rotated = vectors.nearest_lists(x, index.centroids)[:, 0], x @ index.rotation
    hits = work = probed = 0
    for q in range(0, len(x), 100):
        near, bound = [], np.inf
        for k, one in enumerate(vectors.nearest_lists(x[q : q + 1], index.centroids, index.probe)[0]):
            at = np.flatnonzero(of == one)
            v, d, n = vectors.scan(rotated[q], x[q].astype(float), q, rotated[at], x[at], ids[at], bound=bound)
            bound = d[-1] if not k and len(d) == 10 else bound
            near += zip(d, v, strict=True)
            work, probed = work + n, probed + len(at) * x.shape[1]
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        hits += len({v for _, v in sorted(near)[:10]} & set(np.lexsort((ids, d))[:10].tolist()))
    assert hits / 600 >= 0.9 and work < 0.7 * probed and work < 0.2 * 60 * len(x) * x.shape[1]


def test_a_bound_hides_nothing_nearer():
    x = grouped(500)
    exact = x[0].astype(float)
    d = np.sqrt(((x.astype(float) - exact) ** 2).sum(1))
    order = np.lexsort((np.arange(500), d))[1:11]
    for bound in (np.inf, d[order[-1]]):
        found, score, _ = vectors.scan(x[0], exact, 0, x, x, np.arange(500), bound=bound, columns=64)
        assert found.tolist() == order.tolist() and np.array_equal(score, d[order])


def test_repeated_ids(spark):
    """A repeated query is one query, by its least vector; repeated candidates keep a row each."""
    rows = [(0, [2.0, 0.0]), (0, [1.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 3.0])]
    got = search(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, list string")).collect()
    assert [(g.query_id, g.rank, g.vec_id, g.score) for g in sorted(got, key=lambda g: g["rank"])] == [(0, 1, 7, 1.0), (0, 2, 7, 1.0), (0, 3, 8, 3.0)]
