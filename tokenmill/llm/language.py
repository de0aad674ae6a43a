"""Language identification with a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; the largest response
of each filter goes through a softmax layer. The network is trained in numpy on labelled
windows. For prediction, the filters are folded into tables over byte pairs, so that a
filter bank costs one or two look-ups for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.texts import byte_rows, prepare

#: Bounds of the labelled sample: documents of each language, languages, and characters of each document.
FIT_DOCS, FIT_LANGS, FIT_CHARS = 1_200, 400, 4_000
FIT_TOTAL = 100_000_000  # characters of the whole sample, which the driver holds
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EPOCHS, BATCH, RATE = 12, 128, 0.02
UNKNOWN = "und"
_BLOCK = 1 << 19


class Network:
    """Filters per width (width, 256, FILTERS), dense layer and languages."""

    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.filters = [r.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = r.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("langs", "filters", "dense", "bias")}

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest responses of windows (n, WINDOW) of bytes, and where they are."""
        top, at = [], []
        for f in self.filters:
            w = len(f)
            y = f[0][x[:, : WINDOW - w + 1]]
            for j in range(1, w):
                y = y + f[j][x[:, j : WINDOW - w + 1 + j]]
            i = y.argmax(1)
            at.append(i)
            top.append(np.take_along_axis(y, i[:, None], 1)[:, 0])
        return np.concatenate(top, 1), at

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam steps on the cross entropy; only the places of the largest responses get gradients."""
        r = np.random.default_rng(seed)
        values = [*self.filters, self.dense, self.bias]
        m, v, t = [np.zeros_like(a) for a in values], [np.zeros_like(a) for a in values], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), BATCH):
                xb, yb = x[order[a : a + BATCH]], y[order[a : a + BATCH]]
                top, at = self.pooled(xb)
                h = np.maximum(top, 0)
                z = h @ self.dense + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.dense.T) * (top > 0)
                grads = []
                for k, f in enumerate(self.filters):
                    g = np.zeros_like(f)
                    own = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(f)):
                        np.add.at(g[j], (np.take_along_axis(xb, at[k] + j, 1), np.arange(FILTERS)[None]), own)
                    grads.append(g)
                grads += [h.T @ p, p.sum(0)]
                t += 1
                for value, g, mi, vi in zip(values, grads, m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.01 * (g * g - vi)
                    value -= RATE * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.99**t)) + 1e-8)

    @cached_property
    def _tables(self) -> list[list[np.ndarray]]:
        """For each width, tables over pairs (and a last single byte) whose sum is the filter's response."""
        out = []
        for f in self.filters:
            parts = [(f[j][:, None] + f[j + 1][None]).reshape(65536, FILTERS) for j in range(0, len(f) - 1, 2)]
            out.append(parts + ([f[-1]] if len(f) % 2 else []))
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language for windows (n, WINDOW) of bytes."""
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        top = []
        for w, tables in zip(WIDTHS, self._tables, strict=True):
            n = WINDOW - w + 1
            y = tables[0].take(pairs[:, :n], axis=0)
            for k, t in enumerate(tables[1:], 1):
                y += t.take(pairs[:, 2 * k : 2 * k + n] if len(t) == 65536 else x[:, w - 1 : w - 1 + n], axis=0)
            top.append(y.max(1))
        z = np.maximum(np.concatenate(top, 1), 0) @ self.dense + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows(data: bytes) -> np.ndarray:
    """All bytes of a text as windows (n, WINDOW); the last one is padded with zeros."""
    n = -(-len(data) // WINDOW)
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    return x.reshape(n, WINDOW)


def fold(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % parts


def labelled(docs: DataFrame, learn: Column) -> list[tuple[str, bytes]]:
    """A sample of labelled texts, about alike for every language, chosen by a hash of the ids.

    At most FIT_CHARS characters of each text and FIT_DOCS texts of each language, or as many as
    give FIT_TOTAL characters for all of them; the FIT_LANGS most frequent languages are learned.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(FIT_LANGS).collect()
    if not counts:
        return []
    each = max(1, min(FIT_DOCS, FIT_TOTAL // (FIT_CHARS * len(counts))))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.2 * each / r["count"]))])
    chosen = d.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0) < F.element_at(share, F.col("lang")))
    rows = chosen.select("lang", F.substring("text", 1, FIT_CHARS).alias("text"), F.xxhash64("doc_id").alias("k"), "doc_id").orderBy("k", "doc_id", "lang", "text").limit(each * len(counts)).collect()
    return [(r.lang, r.text.encode()) for r in rows]


def train(docs: DataFrame, learn: Column, per_doc: int = 2, seed: int = 5) -> Network | None:
    """A network from the labelled rows that ``learn`` admits; None if there are none."""
    rows = labelled(docs, learn)
    if not rows:
        return None
    r, x, y = np.random.default_rng(seed), [], []
    langs = sorted({lang for lang, _ in rows})
    for lang, data in rows:
        # a whole window, and one of random length, as the last window of a text has
        for k in range(per_doc):
            size = WINDOW if k % 2 == 0 else int(r.integers(8, WINDOW + 1))
            a = int(r.integers(0, max(1, len(data) - size + 1)))
            x.append(windows(data[a : a + size])[0])
            y.append(langs.index(lang))
    net = Network(langs)
    net.fit(np.array(x), np.array(y))
    return net


def _predict(batches: Iterator[pa.RecordBatch], net) -> Iterator[pa.RecordBatch]:
    def flush(texts: list[bytes]) -> tuple[list[str], list[float]]:
        n = net.value
        logs = [np.zeros(len(n.langs)) for _ in texts]
        parts, owner, size = [], [], []
        for i, data in enumerate(texts):
            x = windows(data)
            parts.append(x)
            owner += [i] * len(x)
            size += [WINDOW] * (len(x) - 1) + [len(data) - WINDOW * (len(x) - 1)]
        x = np.concatenate(parts)
        step = 256
        for a in range(0, len(x), step):
            p = n.log_probabilities(x[a : a + step]) * np.array(size[a : a + step])[:, None]
            for i, row in zip(owner[a : a + step], p, strict=True):
                logs[i] += row
        langs, scores = [], []
        for data, z in zip(texts, logs, strict=True):
            z = z / max(1, len(data))
            p = np.exp(z - z.max())
            langs.append(n.langs[int(z.argmax())])
            scores.append(float(p.max() / p.sum()))
        return langs, scores

    for b in batches:
        langs: list[str] = [UNKNOWN] * b.num_rows
        scores = [0.0] * b.num_rows
        held: list[tuple[int, bytes]] = []
        size = 0

        def settle() -> None:
            nonlocal held, size
            if held:
                for (i, _), lang, s in zip(held, *flush([t for _, t in held]), strict=True):
                    langs[i], scores[i] = lang, s
            held, size = [], 0

        letters = b.column("letters").to_pylist()
        for i, data in enumerate(byte_rows(b.column("text"))):
            if net is not None and data and letters[i]:
                held.append((i, data))
                size += len(data)
                if size > _BLOCK:
                    settle()
        settle()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row: the language of the highest mean log probability over all windows of the whole text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    shared = None if net is None else docs.sparkSession.sparkContext.broadcast(net)
    return d.mapInArrow(partial(_predict, net=shared), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row for each row of ``docs``.

    Learns from text and non-null lang of rows whose crc32(doc_id) modulo 4 is not 2 (the others
    are held out; a null id is neither). Texts that are null or have no letter, and all texts if
    nothing could be learned, get ``und`` and score 0. Repeated rows get equal results, an empty
    table gives no rows, and further columns are ignored.
    """
    prepare(docs, "doc_id", "text", "lang")
    p = predict(docs, train(docs, fold() != 2))
    return p.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
