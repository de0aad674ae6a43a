"""Splitting texts before they are encoded."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE, ASCII_SPACE = r"\s", r"\t\n\f\r "
CHUNK, RUN = 400_000, 25_000


def run_slices(text: str, most: int = RUN, chunk: int = CHUNK, space: str = SPACE) -> Iterator[str]:
    """Slices of a text in which no run of white space, or of other characters, is longer than ``most``; none is longer than ``chunk``.

    A text is only cut where a run gets too long, after each ``most`` characters of it, and between chunks.
    ``space`` names the white space as a class of characters: all of Unicode's, or ``ASCII_SPACE``, which is SQL's ``\\s``.
    """
    runs = re.compile(f"[{space}]+|[^{space}]+")
    for a in range(0, len(text), chunk):
        part, start = text[a : a + chunk], 0
        for m in runs.finditer(part):
            for at in range(m.start() + most, m.end(), most):
                yield part[start:at]
                start = at
        yield part[start:]


def split_runs(text: Column, most: int = RUN, chunk: int = CHUNK, space: str = SPACE) -> Column:
    """The slices as an array; null for null."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(run_slices(t, most, chunk, space)) if isinstance(t, str) else None)

    return split(text)
