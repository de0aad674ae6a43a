"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text: one of ordinary words, one of the
same words and of what is typical of toxic text. A window of words that compresses better
with the second has toxic content: as both share the ordinary part, ordinary words cost the
same with either. A document's features come from the differences of all its windows, and a
logistic curve fitted on further labelled documents turns them into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, partial
from heapq import nlargest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tokenmill.llm.texts import byte_rows, free_names, map_rows, prepare, word_blocks

#: Bounds of the labelled sample: documents of each label, and characters of each document.
FIT_TOXIC, FIT_ORDINARY, FIT_CHARS = 1_500, 4_500, 12_000
#: Share of the sample for the dictionaries; the rest fits the curve.
DICTIONARY_SHARE = 0.6
ORDINARY_WORDS = 2_000
TOXIC_WORDS = 2_000
#: Least contexts, likelihood ratio statistic and log odds of a word of the toxic dictionary.
MIN_CONTEXTS, MIN_RATIO, MIN_ODDS = 4, 25.0, 2.0
WINDOW = 8
LEVEL = 12


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def contexts(texts: Iterable[bytes]) -> Counter:
    """How many different neighbourhoods (word before, word after) each word has; copies of a text add nothing."""
    seen: set[int] = set()
    found: Counter = Counter()
    for t in texts:
        w = _words(t)
        for p, x, q in zip([b"", *w[:-1]], w, [*w[1:], b""], strict=True):
            h = hash((p, x, q))
            if h not in seen:
                seen.add(h)
                found[x] += 1
    return found


def typical(toxic: Counter, ordinary: Counter) -> list[bytes]:
    """Words typical of toxic text, most typical last, by likelihood ratio and odds of their contexts."""
    n1, n0 = sum(toxic.values()), sum(ordinary.values())
    found = []
    for w, a in toxic.items():
        b = ordinary.get(w, 0)
        if a < MIN_CONTEXTS or not n0:
            continue
        e1, e0 = (a + b) * n1 / (n0 + n1), (a + b) * n0 / (n0 + n1)
        ratio = 2 * (a * math.log(a / e1) + (b * math.log(b / e0) if b else 0))
        if a > e1 and ratio >= MIN_RATIO and math.log((a + 0.5) * n0 / (n1 * (b + 0.5))) >= MIN_ODDS:
            found.append((ratio, w))
    return [w for _, w in sorted(found)[-TOXIC_WORDS:]]


class Model:
    """Dictionaries and curve; pickles small, and builds its compressors where it is used."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        self.ordinary = b" " + b"  ".join(ordinary) + b" "
        self.toxic = b" " + b"  ".join(toxic) + b" " if toxic else b""
        self.weights = np.zeros(6)
        self.weights[0] = -1e4

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "weights": self.weights}

    @cached_property
    def _sizes(self):
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, window_log=18, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

        def compressor(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

        return compressor(self.toxic + self.ordinary), compressor(self.ordinary)

    def features(self, text: bytes | None) -> np.ndarray:
        """1, the largest and the second largest gain, and logs of the gains' sum, of the number of clear gains and of the windows."""
        if not self.toxic:
            return np.array([1.0, 0, 0, 0, 0, 0])
        toxic, ordinary = self._sizes
        # every window follows the same known bytes, so that short ones are not stored raw
        prefix = self.ordinary[-40:] + b" "
        first = second = total = clear = n = 0
        for words in word_blocks((text or b"").lower()):
            for i in range(0, len(words), WINDOW):
                w = prefix + b"  ".join(words[i : i + WINDOW]) + b" "
                gain = len(ordinary(w)) - len(toxic(w))
                n += 1
                if gain > 0:
                    total += gain
                    clear += gain >= 3
                    if gain > first:
                        first, second = gain, first
                    elif gain > second:
                        second = gain
        return np.array([1.0, first, second, math.log1p(total), math.log1p(clear), math.log1p(n)])

    def score(self, x: np.ndarray) -> float:
        z = float(x @ self.weights)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def fit_curve(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> None:
        """Logistic regression by Newton steps."""
        if not len(y) or y.all() or not y.any():
            return
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + ridge * w
            hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """A model from labelled texts. Without toxic texts every score is 0."""
    a, b = math.ceil(len(toxic) * DICTIONARY_SHARE), math.ceil(len(ordinary) * DICTIONARY_SHARE)
    c1, c0 = contexts(toxic[:a]), contexts(ordinary[:b])
    usual = [w for _, w in nlargest(ORDINARY_WORDS, ((n, w) for w, n in c0.items()))][::-1]
    model = Model(typical(c1, c0), usual)
    if model.toxic:
        rest = toxic[a:] + ordinary[b:]
        x = np.array([model.features(t) for t in rest]).reshape(-1, 6)
        model.fit_curve(x, np.array([1.0] * len(toxic[a:]) + [0.0] * len(ordinary[b:])))
    return model


def labelled(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[list[bytes], list[bytes]]:
    """A bounded sample of labelled texts (toxic, ordinary), in the order of a hash of their ids. Documents with several labels count as toxic if one says so."""
    y = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where(learn)
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = []
    for value, most in ((1, FIT_TOXIC), (0, FIT_ORDINARY)):
        # at most FIT_* ids: a broadcast of proven size
        ids = F.broadcast(y.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring(F.col("text").cast("string"), 1, FIT_CHARS).alias("text")).where("text is not null").join(ids, "doc_id")
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).select("text").collect()
        out.append([r.text.encode() for r in rows])
    return out[0], out[1]


def fold(doc_id: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % parts


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents outside the held-out fold (remainder 0)."""
    return fit(*labelled(docs, labels, fold() != 0))


def _score(batches: Iterator[pa.RecordBatch], model, name: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = [model.value.score(model.value.features(x)) for x in byte_rows(b.column("text"))]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])


def scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1; texts are scored whole, one in memory at a time."""
    prepare(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_rows(docs, partial(_score, model=shared, name=name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row for each row of ``docs``.

    Labels are learned from rows whose crc32(doc_id) modulo 5 is not 0 (the others are held
    out); null ids are neither. The score of a null, empty or blank text is that of a text
    without gains. Repeated rows are scored alike; without labels all scores are 0; an empty
    table gives no rows, and further columns are ignored.
    """
    prepare(docs, "doc_id", "text")
    prepare(labels, "doc_id", "toxic")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    s = scored(d, train(docs, labels), "score").drop("text")
    return s.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; the model is trained on ``docs`` and ``labels``.

    Null and empty texts score like texts without gains and stay, as do all rows where nothing could be
    learned; rows of a null doc_id are judged by their text. Repeated rows are judged alike, an empty table
    gives none, and other columns pass through unchanged, whatever their names.
    """
    prepare(docs, "doc_id", "text")
    prepare(labels, "doc_id", "toxic")
    (name,) = free_names(docs, "score")
    return scored(docs, train(docs, labels), name).where(F.col(name) < threshold).drop(name)
