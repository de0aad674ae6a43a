"""Running statistics of a metric stream.

An extension: metric rows arrive as a stream instead of a finished log. The sliding z-score
and the exponential mean keep one small state for each stream of metrics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.operators.trainstats import WINDOW

OUT = "stream string, step long, value double, z double, ema double"
STATE = "n long, ema double, last array<double>"


def _score(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    n, ema, last = state.get if state.exists else (0, 0.0, [])
    last = list(last)
    rows = pd.concat(list(parts)).sort_values("step")
    out = []
    for step, value in zip(rows["step"], rows["value"], strict=True):
        n += 1
        last = [*last, float(value)][-WINDOW:]
        ema = 0.95 * ema + 0.05 * value
        z = None
        if n > WINDOW:
            mean = sum(last) / len(last)
            sd = math.sqrt(max(0.0, sum((x - mean) ** 2 for x in last) / len(last)))
            z = (value - mean) / sd if sd else 0.0
        out.append((key[0], int(step), float(value), z, ema / (1 - 0.95**n)))
    state.update((n, ema, last))
    yield pd.DataFrame(out, columns=["stream", "step", "value", "z", "ema"])


def score_stream(metrics: DataFrame) -> DataFrame:
    """z-score and bias-corrected exponential mean of a stream ``stream, step, value``; rows of a micro-batch are taken in the order of steps."""
    return metrics.select("stream", F.col("step").cast("long"), F.col("value").cast("double")).groupBy("stream").applyInPandasWithState(_score, OUT, STATE, "append", "NoTimeout")


def windowed_means(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means over tumbling windows of event time; later rows than ``late`` are dropped by the watermark."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), by)
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), by, "n", "mean")
