"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Vectors are assigned to the nearest of the k-means centroids of a bounded sample, and stored
rotated by a random orthogonal matrix. A bounded part of a query's nearest list is searched
first, and the distance of the tenth best there is the bound that the query takes to all other
lists it probes. In each of them, distances are summed over blocks of rotated columns; after
each block, a hypothesis test compares the partial sum, scaled to all columns, with the bound,
and abandons candidates that are almost surely farther. Survivors are measured exactly, in
double precision, and tighten the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.texts import prepare
from tokenmill.scratch import stage

K = 10
EVERY = 100
#: Bounds of the sample that the index is fitted on, and of its lists.
SAMPLE, MAX_LISTS = 20_000, 4_096
#: Share of the sample's true neighbours that the probed lists must hold.
TARGET = 0.95
#: Candidates and queries of one task.
CANDIDATES, QUERIES = 4_096, 512
#: Columns of a block, and how far the test's threshold lies above the bound.
COLUMNS, EPSILON = 8, 1.0
#: Candidates that are taken together against one bound: the first of a list, as long as there is none, and later ones.
FIRST, WAVE = 64, 1_024


def matrix(column: pa.Array, dim: int, kind=np.float32) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), dim)


def nearest_lists(x: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the n nearest centroids of each row, nearest first."""
    out = np.empty((len(x), n), np.int32)
    norm = (centroids**2).sum(1)
    for a in range(0, len(x), 4096):
        d = norm - 2 * x[a : a + 4096] @ centroids.T
        out[a : a + 4096] = d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


class Index:
    """Centroids, rotation and number of lists to probe."""

    def __init__(self, centroids: np.ndarray, rotation: np.ndarray, probe: int):
        self.centroids, self.rotation, self.probe, self.dim = centroids, rotation, probe, centroids.shape[1]


def fit(sample: np.ndarray, total: int, seed: int = 3, rounds: int = 10) -> Index:
    """k-means on the sample, and the fewest probes that reach TARGET of the true neighbours among the sample."""
    r = np.random.default_rng(seed)
    n, dim = sample.shape
    lists = max(1, min(MAX_LISTS, round(total**0.5), n // 4 or 1))
    c = sample[r.choice(n, lists, replace=False)].copy()
    for _ in range(rounds):
        of = nearest_lists(sample, c)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, of, sample)
        count = np.bincount(of, minlength=lists)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c).astype(np.float32)
    rotation = np.linalg.qr(r.normal(size=(dim, dim)))[0].astype(np.float32)
    of = nearest_lists(sample, c)[:, 0]
    need = []
    for i in r.choice(n, min(n, 200), replace=False):
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(K, n - 1)]
        order = np.empty(lists, np.int64)
        order[nearest_lists(sample[i : i + 1], c, lists)[0]] = np.arange(lists)
        need.append(order[of[near]])
    need = np.sort(np.concatenate(need)) if need else np.zeros(0, np.int64)
    probe = int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) + 1 if len(need) else 1
    return Index(c, rotation, min(lists, probe))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of vectors that are not null, empty or zero and have finite components only."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def _assign(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    ix = index.value
    for b in batches:
        x = matrix(b.column("embedding"), ix.dim)
        rotated = pa.FixedSizeListArray.from_arrays(pa.array((x @ ix.rotation).ravel()), ix.dim).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), rotated, pa.array(nearest_lists(x, ix.centroids)[:, 0])], ["vec_id", "embedding", "rotated", "list"])


def _probes(batches: Iterator[pa.RecordBatch], index, sizes: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The nearest lists of each query, more than the index asks for where those hold fewer than k other vectors."""
    ix = index.value
    for b in batches:
        x, least = matrix(b.column("embedding"), ix.dim), b.column("own").to_numpy() + k
        lists = list(nearest_lists(x, ix.centroids, ix.probe))
        for i in np.flatnonzero(np.array([sizes[near].sum() for near in lists]) < least):
            order = nearest_lists(x[i : i + 1], ix.centroids, len(ix.centroids))[0]
            lists[i] = order[: int(np.searchsorted(np.cumsum(sizes[order]), least[i])) + 1]
        rest = [n for n in b.schema.names if n != "own"]
        yield pa.RecordBatch.from_arrays([*map(b.column, rest), pa.array(lists, pa.list_(pa.int32()))], [*rest, "lists"])


def scan(query: np.ndarray, exact: np.ndarray, own: int, rotated: np.ndarray, embedding: np.ndarray, ids: np.ndarray, k: int = K, bound: float = np.inf, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and distances of the k nearest candidates of one list that are within ``bound``, ties to the smaller id; and how many components were read for it."""
    dim, wave, work = rotated.shape[1], FIRST if np.isinf(bound) else WAVE, 0
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    limit, a = bound**2, 0
    while a < len(ids):
        at = a + np.flatnonzero(ids[a : a + wave] != own)
        part = np.zeros(len(at), np.float32)
        for c in range(0, dim if np.isfinite(limit) else 0, columns):
            e = min(dim, c + columns)
            part += ((rotated[at, c:e] - query[c:e]) ** 2).sum(1)
            work += len(at) * (e - c)
            slack = (1 + EPSILON / np.sqrt(e)) ** 2 if e < dim else 1.0001
            stay = part * (dim / e) <= limit * slack + 1e-9
            at, part = at[stay], part[stay]
        d = np.sqrt(((embedding[at].astype(np.float64) - exact) ** 2).sum(1))
        work += d.size * dim
        best_d, best_i = np.r_[best_d, d], np.r_[best_i, ids[at]]
        order = np.lexsort((best_i, best_d))[:k]
        best_d, best_i = best_d[order], best_i[order]
        if len(best_d) == k:
            limit = min(limit, best_d[-1] ** 2)
        a, wave = a + wave, min(wave * 2, WAVE)
    return best_i, best_d, work


_KINDS = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(candidates: pa.Table, queries: pa.Table, dim: int, k: int) -> pa.Table:
    if not len(candidates) or not len(queries):
        return _FOUND.empty_table()
    ids = candidates.column("vec_id").to_numpy()
    rotated, embedding = matrix(candidates.column("rotated"), dim), matrix(candidates.column("embedding"), dim)
    q_ids, bounds = queries.column("vec_id").to_numpy(), queries.column("bound").to_numpy()
    q_rotated, q_exact = matrix(queries.column("rotated"), dim), matrix(queries.column("embedding"), dim, np.float64)
    qs, vs, ds = [], [], []
    for i, own in enumerate(q_ids):
        v, d, _ = scan(q_rotated[i], q_exact[i], own, rotated, embedding, ids, k, bounds[i])
        qs.append(np.full(len(v), own))
        vs.append(v)
        ds.append(d)
    return pa.table([np.concatenate(qs), np.concatenate(vs), np.concatenate(ds)], schema=_FOUND)


def search(vectors: DataFrame, is_query: Column | None = None, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query, nearest first, ties to the smaller vec_id.

    Queries are the rows that ``is_query`` admits (vec_id divisible by 100), candidates all rows
    but those of the query's own vec_id; score is the Euclidean distance in double precision.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    those of another dimension than most have. A repeated query id is one query, by its least
    vector; repeated candidates keep a row each. Fewer candidates than k give all of them; an
    empty table gives no rows, and further columns are ignored.

    The index is fitted on at most SAMPLE vectors and holds every vector. A task gets at most
    about CANDIDATES vectors of one list and QUERIES of its queries: larger lists (one that holds
    a third of all vectors, say) and their queries are cut by a hash of their ids. A bound is the
    distance of a k-th neighbour that was found, so it never hides a nearer one; only the test does.
    """
    prepare(vectors, "vec_id", "embedding")
    sc = vectors.sparkSession.sparkContext
    good = usable(vectors)
    shapes = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if shapes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = shapes["dim"], shapes["count"]
    good = good.where(F.size("embedding") == dim)
    rows = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) / 1_000_003.0 < min(1.0, 1.1 * SAMPLE / total)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    sample = matrix(rows.column("embedding"), dim)
    if not len(sample):
        sample = matrix(good.limit(1).select("embedding").toArrow().column("embedding"), dim)
    index = fit(sample, total)
    shared = sc.broadcast(index)
    assigned, _ = stage(good.mapInArrow(partial(_assign, index=shared), "vec_id long, embedding array<float>, rotated array<float>, list int"), "ann-index")
    is_query = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    one = assigned.where(is_query).groupBy("vec_id").agg(F.min(F.struct("embedding", "rotated")).alias("v"), F.count("*").alias("own")).select("vec_id", "v.*", "own")
    # one row for each list, at most MAX_LISTS
    sizes = {r["list"]: [r["n"], 0] for r in assigned.groupBy("list").agg(F.count("*").alias("n")).collect()}
    held = np.array([sizes.get(i, (0, 0))[0] for i in range(len(index.centroids))])
    probed = one.mapInArrow(partial(_probes, index=shared, sizes=held, k=k), "vec_id long, embedding array<float>, rotated array<float>, lists array<int>")
    probed, _ = stage(probed.select("vec_id", "embedding", "rotated", F.posexplode("lists").alias("nth", "list")), "ann-queries")
    for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r["list"], [0, 0])[1] = r["n"]
    parts = lambda j, most: F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(i, (0, 0))[j] // most))) for i in range(len(index.centroids))]), F.col("list") + 1)
    c_parts, q_parts = parts(0, CANDIDATES), parts(1, QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    meet = lambda c, q: c.groupBy("list", "c", "q").cogroup(q.groupBy("list", "c", "q")).applyInArrow(partial(_search, dim=dim, k=k), _KINDS)
    candidates = assigned.withColumn("c", F.pmod(F.xxhash64("vec_id"), c_parts).cast("int")).withColumn("q", every(q_parts))
    dealt = probed.withColumn("q", F.pmod(F.xxhash64("vec_id"), q_parts).cast("int"))
    # one part of the nearest list, of bounded size however long the list is, gives a query its bound
    home = dealt.where("nth = 0").withColumns({"c": F.lit(0), "bound": F.lit(float("inf"))})
    near, _ = stage(meet(candidates.where("c = 0"), home), "ann-near")
    bounds = near.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("bound")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "bound")
    queries = dealt.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).withColumn("c", every(c_parts))
    found = near.union(meet(candidates, queries.where("nth > 0 or c > 0")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
