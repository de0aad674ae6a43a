"""Learning-rate schedules as functions of a step column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("cosine", "linear", "constant", "wsd")


def _warm(step: Column, peak: float, warmup: int, then: Column) -> Column:
    return F.when(step < warmup, F.lit(peak) * (step + 1) / warmup).otherwise(then) if warmup else then


def cosine(step: Column, peak: float, warmup: int, total: int, final_share: float = 0.0, clamp: bool = True) -> Column:
    """Linear warm-up, then half a cosine down to ``final_share`` of the peak; with ``clamp`` the rate stays there."""
    low = peak * final_share
    r = (step - warmup) / F.lit(float(total - warmup))
    falling = low + 0.5 * (1 + F.cos(r * math.pi)) * (peak - low)
    return _warm(step, peak, warmup, F.when(step > total, F.lit(low)).otherwise(falling) if clamp else falling)


def linear(step: Column, peak: float, warmup: int, total: int, final_share: float = 0.0) -> Column:
    low = peak * final_share
    return _warm(step, peak, warmup, F.lit(peak) - (step - warmup) / F.lit(float(total - warmup)) * (peak - low))


def constant(step: Column, peak: float) -> Column:
    return F.lit(peak) + step * 0.0


def wsd(step: Column, peak: float, warmup: int, total: int, final_share: float = 0.0, stable: float = 0.8) -> Column:
    """Warm-up, a flat part, and a decay with the square root of the time since."""
    low, point = peak * final_share, int(stable * total)
    r = (step - point) / F.lit(float(total - point))
    decay = low + (1 - F.sqrt(F.greatest(r, F.lit(0.0)))) * (peak - low)
    return _warm(step, peak, warmup, F.when(step < point, F.lit(peak)).otherwise(decay))


def by_name(name: Column, step: Column, peak: float, warmup: int, total: int, final_share: float = 0.0) -> Column:
    """The schedule that a column names; null for other names."""
    return (
        F.when(name == "cosine", cosine(step, peak, warmup, total, final_share))
        .when(name == "linear", linear(step, peak, warmup, total, final_share))
        .when(name == "constant", constant(step, peak))
        .when(name == "wsd", wsd(step, peak, warmup, total, final_share))
    )
