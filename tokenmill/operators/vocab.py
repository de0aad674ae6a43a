"""Vocabulary selection: by frequency, clustering, relaxed independent sets, entropy, and marginal gain.

A vocabulary is a table ``token_id, token, kind``: 256 single bytes, the selected tokens, padding,
and the end-of-text token last. Candidate lists are cut to a fixed number of rows before any
of them reaches the driver.
"""

from __future__ import annotations

import heapq
from collections import deque
from itertools import chain

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.operators.bytelm import ByteLM, surprise_histogram, threshold, train_lm
from tokenmill.operators.minhash import band_rows, candidate_pairs, clusters, signatures
from tokenmill.operators.ngrams import most_frequent
from tokenmill.operators.segment import segment_counts, segment_pair_counts

EOT, PAD = b"<|endoftext|>", b"<|pad|>"
VOCAB = T.StructType([T.StructField("token_id", T.IntegerType(), False), T.StructField("token", T.BinaryType(), False), T.StructField("kind", T.StringType(), False)])


def layout(spark: SparkSession, selected: list[bytes], vocab_size: int) -> DataFrame:
    """The vocabulary table of the selected tokens, in order; repeats and single bytes among them are left out."""
    if vocab_size < 257:
        raise ValueError("a vocabulary has 257 tokens at least")
    seen = {bytes([i]) for i in range(256)}
    rows = [(i, bytes([i]), "byte") for i in range(256)]
    for t in selected:
        if t not in seen and len(rows) < vocab_size - 1:
            seen.add(t)
            rows.append((len(rows), t, "token"))
    rows += [(i, PAD, "pad") for i in range(len(rows), vocab_size - 1)]
    return spark.createDataFrame([*rows, (vocab_size - 1, EOT, "eot")], VOCAB)


def _tokens(df: DataFrame) -> list[bytes]:
    return [bytes(r["token"]) for r in df.select("token").collect()]


def _unhex(df: DataFrame) -> DataFrame:
    return df.withColumn("token", F.unhex("gram"))


def frequency_candidates(docs: DataFrame, k: int, min_n: int = 2, max_n: int = 8) -> DataFrame:
    """``n, gram, freq`` of the k most frequent grams overall; they are among the k most frequent of each size, so the sizes need no list of their own."""
    return most_frequent(docs, k, tuple(range(min_n, max_n + 1)))


def frequency_vocab(docs: DataFrame, vocab_size: int, min_n: int = 2, max_n: int = 8) -> DataFrame:
    chosen = frequency_candidates(docs, vocab_size - 257, min_n, max_n)
    return layout(docs.sparkSession, _tokens(_unhex(chosen).orderBy(F.desc("freq"), "n", "gram")), vocab_size)


def ranked(docs: DataFrame, k: int, min_n: int = 2, max_n: int = 8) -> DataFrame:
    """``cand_id, token, freq``: candidates numbered by frequency."""
    rows = _unhex(frequency_candidates(docs, k, min_n, max_n)).orderBy(F.desc("freq"), "n", "gram").collect()
    return docs.sparkSession.createDataFrame([(i, bytes(r["token"]), r["freq"]) for i, r in enumerate(rows)], "cand_id long, token binary, freq long")


def cluster_vocab(docs: DataFrame, vocab_size: int, factor: int = 10, min_n: int = 2, max_n: int = 8) -> DataFrame:
    """Representatives (the most frequent member) of MinHash clusters of candidates, by frequency."""
    grams = ranked(docs, (vocab_size - 256) * factor, min_n, max_n)
    found = clusters(grams, band_rows(signatures(grams)))
    return layout(docs.sparkSession, _tokens(found.where("cand_id = cluster").orderBy("cand_id").limit(vocab_size - 257)), vocab_size)


class _Flow:
    """Maximum flow by levels (Dinic)."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, c: float) -> None:
        for x, y, z in ((a, b, c), (b, a, 0.0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(z)

    def reachable(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.cap[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def run(self, s: int, t: int) -> list[int]:
        """Levels of the residual graph once no path is left."""
        while (level := self.reachable(s))[t] >= 0:
            at = [0] * len(self.out)
            while True:
                path, x = [], s
                while x != t:
                    while at[x] < len(self.out[x]):
                        e = self.out[x][at[x]]
                        if self.cap[e] > 1e-9 and level[self.to[e]] == level[x] + 1:
                            break
                        at[x] += 1
                    if at[x] == len(self.out[x]):
                        if not path:
                            break
                        x = self.to[path.pop() ^ 1]
                        at[x] += 1
                        continue
                    path.append(e)
                    x = self.to[e]
                if x != t:
                    break
                least = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= least
                    self.cap[e ^ 1] += least
        return level


def _cover(weights: list[float], edges: list[tuple[int, int]]) -> list[float]:
    """The same of a connected part: the least weighted cover of the bipartite double graph is a minimum cut."""
    n = len(weights)
    flow = _Flow(2 * n + 2)
    s, t = 2 * n, 2 * n + 1
    for i, w in enumerate(weights):
        flow.add(s, i, max(w, 0.0))
        flow.add(n + i, t, max(w, 0.0))
    for a, b in edges:
        flow.add(a, n + b, float("inf"))
        flow.add(b, n + a, float("inf"))
    level = flow.run(s, t)
    return [0.0 if w <= 0 else 1 - ((level[i] < 0) + (level[n + i] >= 0)) / 2 for i, w in enumerate(weights)]


def _connected(edges: list[tuple[int, int]]) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """Nodes and edges, by their place among the nodes, of each connected part with an edge."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    nodes: dict[int, list[int]] = {}
    for x in sorted(root):
        nodes.setdefault(find(x), []).append(x)
    place = {x: i for part in nodes.values() for i, x in enumerate(part)}
    inside: dict[int, list[tuple[int, int]]] = {}
    for a, b in edges:
        inside.setdefault(find(a), []).append((place[a], place[b]))
    return [(part, inside[r]) for r, part in nodes.items()]


def relaxed_independent_set(weights: list[float], edges: list[tuple[int, int]], parts: list | None = None) -> list[float]:
    """An optimal y for max sum w y with y_a + y_b <= 1 on edges and 0 <= y <= 1; each y is 0, 1/2 or 1.

    Connected parts (``parts``, if known) don't bear on each other and are solved one by one.
    """
    y = [float(w > 0) for w in weights]
    for nodes, inside in _connected(edges) if parts is None else parts:
        for i, v in zip(nodes, _cover([weights[i] for i in nodes], inside), strict=True):
            y[i] = v
    return y


def select_independent(freqs: list[int], edges: list[tuple[int, int]], most: int) -> list[int]:
    """Up to ``most`` candidates without conflicts, by rounding the relaxed problem in the order of y f.

    The budget enters as a price on every candidate, found by bisection. Without edges this is the top of the list.
    """
    if not edges:
        return list(range(min(most, len(freqs))))
    low, high = 0.0, float(max(freqs))
    parts = _connected(edges)
    y = relaxed_independent_set([float(f) for f in freqs], edges, parts)
    if sum(y) > most:
        for _ in range(30):
            price = (low + high) / 2
            y = relaxed_independent_set([f - price for f in freqs], edges, parts)
            low, high = (price, high) if sum(y) > most else (low, price)
        y = relaxed_independent_set([f - high for f in freqs], edges, parts)
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    chosen, blocked = [], set()
    for i in sorted(range(len(freqs)), key=lambda i: (-y[i] * freqs[i], i)):
        if len(chosen) == most:
            break
        if i not in blocked:
            chosen.append(i)
            blocked.update(near.get(i, ()))
    return sorted(chosen)


def independent_vocab(docs: DataFrame, vocab_size: int, factor: int = 10, min_n: int = 2, max_n: int = 8) -> DataFrame:
    """Candidates of which no two share a bucket; the candidates and their pairs are bounded by ``factor``."""
    grams = ranked(docs, (vocab_size - 256) * factor, min_n, max_n)
    rows = grams.orderBy("cand_id").collect()
    edges = [(r["a"], r["b"]) for r in candidate_pairs(band_rows(signatures(grams))).collect()]
    chosen = select_independent([r["freq"] for r in rows], edges, vocab_size - 257)
    return layout(docs.sparkSession, [bytes(rows[i]["token"]) for i in chosen], vocab_size)


def entropy_tokens(counts: DataFrame, lm: ByteLM, k: int, min_count: int = 10, pmi_min: float | None = 0.0) -> DataFrame:
    """``token, freq, pmi`` of the k best segments: two bytes or more, frequent, associated; by frequency, then association, then bytes."""
    shared = counts.sparkSession.sparkContext.broadcast(lm)

    @F.pandas_udf("double")
    def pmi(tokens):  # noqa: ANN001, ANN202
        table = shared.value.associations()
        return tokens.map(lambda t: shared.value.pmi(bytes(t), table))

    d = counts.where((F.octet_length("token") > 1) & (F.col("freq") >= min_count)).withColumn("pmi", F.round(pmi("token"), 9))
    if pmi_min is not None:
        d = d.where(F.col("pmi") >= pmi_min)
    return d.orderBy(F.desc("freq"), F.desc("pmi"), F.hex("token")).limit(k)


def entropy_vocab(docs: DataFrame, vocab_size: int, percentile: float = 0.8, max_len: int = 16, min_count: int = 10, pmi_min: float | None = 0.0, order: int = 3) -> DataFrame:
    """Segments between surprising bytes, filtered by frequency and association."""
    lm = train_lm(docs, order)
    tau = threshold(surprise_histogram(docs, lm), percentile)
    best = entropy_tokens(segment_counts(docs, lm, tau, max_len), lm, vocab_size - 257, min_count, pmi_min)
    return layout(docs.sparkSession, _tokens(best.orderBy(F.desc("freq"), F.desc("pmi"), F.hex("token"))), vocab_size)


def shortest_costs(data: bytes, vocab: set[bytes], max_len: int) -> np.ndarray:
    """Fewest tokens for every prefix (a single byte is always a token)."""
    n = len(data)
    dp = np.arange(n + 1)
    for i in range(n):
        c = dp[i] + 1
        if c < dp[i + 1]:
            dp[i + 1] = c
        for size in range(2, min(max_len, n - i) + 1):
            if data[i : i + size] in vocab and c < dp[i + size]:
                dp[i + size] = c
    return dp


def occurrences(data: bytes, tokens: list[bytes]) -> dict[bytes, np.ndarray]:
    """All places where each token starts, overlaps included, from one pass over the data; tokens without any are left out."""
    tokens = [t for t in dict.fromkeys(tokens) if t]
    if not tokens:
        return {}
    a = ahocorasick.Automaton()
    for k, t in enumerate(tokens):
        a.add_word(t.decode("latin-1"), k)  # a character for each byte
    a.make_automaton()
    hits = np.fromiter(chain.from_iterable(a.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
    by = hits[np.argsort(hits[:, 1], kind="stable")]
    cuts = np.searchsorted(by[:, 1], np.arange(len(tokens) + 1))
    return {t: by[x:y, 0] - len(t) + 1 for t, x, y in zip(tokens, cuts, cuts[1:], strict=False) if y > x}


def greedy_gain(data: bytes, tokens: list[bytes], most: int, max_len: int = 16, every: int = 500) -> list[bytes]:
    """Tokens by marginal saving, with lazy re-evaluation.

    The saving of a token is the sum of max(0, dp[end] - dp[start] - 1) over its places. A chosen
    token relaxes dp at its places; after ``every`` choices dp is computed anew. A heap holds the
    last known savings, staler first among equals, then smaller bytes.
    """
    places = occurrences(data, tokens)
    dp, chosen, vocab = np.arange(len(data) + 1), [], set()
    gain = lambda t: int(np.maximum(0, dp[places[t] + len(t)] - dp[places[t]] - 1).sum())
    heap = [(-gain(t), 0, t) for t in places]
    heapq.heapify(heap)
    while heap and len(chosen) < most:
        saving, stamp, t = heapq.heappop(heap)
        if stamp < len(chosen):
            if (g := gain(t)) > 0:
                heapq.heappush(heap, (-g, len(chosen), t))
            continue
        if saving == 0:
            break
        chosen.append(t)
        vocab.add(t)
        at = places[t]
        dp[at + len(t)] = np.minimum(dp[at + len(t)], dp[at] + 1)
        if len(chosen) % every == 0:
            dp = shortest_costs(data, vocab, max_len)
    return chosen


def gain_candidates(docs: DataFrame, k: int, percentile: float = 0.8, max_len: int = 16, min_count: int = 10, order: int = 3) -> DataFrame:
    """``token, freq``: the k most frequent segments and adjacent pairs."""
    lm = train_lm(docs, order)
    tau = threshold(surprise_histogram(docs, lm), percentile)
    return segment_pair_counts(docs, lm, tau, max_len).where(F.col("freq") >= min_count).orderBy(F.desc("freq"), F.octet_length("token"), F.hex("token")).limit(k)


def gain_vocab(docs: DataFrame, vocab_size: int, sample_bytes: int = 2_000_000, factor: int = 10, percentile: float = 0.8, max_len: int = 16, min_count: int = 10, order: int = 3) -> DataFrame:
    """Candidates from the whole table, chosen greedily by their saving on a byte-budgeted sample."""
    from tokenmill.operators.corpus import corpus_prefix

    tokens = _tokens(gain_candidates(docs, (vocab_size - 257) * factor, percentile, max_len, min_count, order))
    parts = corpus_prefix(docs, sample_bytes).orderBy("doc_id").select("data").collect()
    return layout(docs.sparkSession, greedy_gain(b"".join(bytes(r["data"]) for r in parts), tokens, vocab_size - 257, max_len), vocab_size)
