"""Numeric primitives over arrays and rows: softmax, losses, sampling, norms, utilisation, generators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once; inside a lambda, Spark would compute it for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def softmax(logits: Column) -> Column:
    """Of an array, shifted by its maximum."""
    shifted = lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    return _let(F.array_max(logits).cast("double"), lambda top: _let(shifted(top), lambda e: _let(_sum(e), lambda s: F.transform(e, lambda x: x / s))))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log of the softmax at a 0-based target, without dividing small numbers."""
    total = lambda top: F.log(_sum(F.transform(logits, lambda x: F.exp(x.cast("double") - top)))) + top
    return _let(F.array_max(logits).cast("double"), total) - F.get(logits, target).cast("double")


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(F.lit(math.sqrt(2 / math.pi)) * (x + 0.044715 * x * x * x)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def standardise(a: Column, eps: float = 1e-5) -> Column:
    """Mean 0 and deviation 1 over an array."""
    n = F.size(a)
    mean = _sum(F.transform(a, lambda x: x.cast("double"))) / n
    scaled = lambda m: _let(F.sqrt(_sum(F.transform(a, lambda x: F.pow(x.cast("double") - m, F.lit(2)))) / n + eps), lambda d: F.transform(a, lambda x: (x.cast("double") - m) / d))
    return _let(mean, scaled)


def global_norm(df: DataFrame, vector: str) -> DataFrame:
    """L2 norm over all components of all rows: squares are summed by row, then by partition, then once."""
    return df.select(dot(F.col(vector), F.col(vector)).alias("s")).agg(F.sqrt(F.sum("s")).alias("norm"), F.count("*").alias("n"))


def top_k_crop(logits: DataFrame, key: str, k: int) -> DataFrame:
    """Rows ``key, i, logit`` that reach the k-th largest logit of their key; ties with it stay."""
    rank = F.rank().over(Window.partitionBy(key).orderBy(F.desc("logit")))
    return logits.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def nucleus(probs: DataFrame, key: str, p: float) -> DataFrame:
    """Rows ``key, i, prob`` of the most probable entries while the sum before them is at most p, scaled to sum to 1."""
    w = Window.partitionBy(key).orderBy(F.desc("prob"), "i")
    d = probs.withColumn("__before", F.coalesce(F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where(F.col("__before") <= p)
    return d.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy(key))).drop("__before")


def cdf_sample(probs: DataFrame, key: str, coin: Column) -> DataFrame:
    """``key, chosen``: the first entry at which the running sum exceeds the coin, or the last one."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = probs.withColumn("__coin", coin).withColumn("__cdf", F.sum("prob").over(w))
    return d.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("__coin") < F.col("__cdf"), F.col("i"))), F.max("i")).alias("chosen"))


def promised_tflops(base: Column, cores: Column, base_cores: Column, clock: Column, base_clock: Column) -> Column:
    """Peak of a device, scaled from that of its reference chip."""
    return base * (cores / base_cores) * (clock / base_clock)


def utilisation(params: Column, layers: Column, channels: Column, length: Column, tokens: Column, seconds: Column, peak_tflops: Column) -> Column:
    """Model FLOPs (6 N + 6 L C T for each token) by time, as a share of the peak."""
    return (6 * params + 6 * layers * channels * length) * tokens / seconds / (peak_tflops * 1e12)


def xorshift_star(state: Column) -> tuple[Column, Column]:
    """Next state of the 64-bit xorshift* generator, and its 32-bit output."""
    s = state.bitwiseXOR(F.shiftrightunsigned(state, 12))
    s = s.bitwiseXOR(F.shiftleft(s, 25))
    s = s.bitwiseXOR(F.shiftrightunsigned(s, 27))
    # the product modulo 2^64 from 32-bit halves, as signed BIGINT products would overflow
    m = 0x2545F4914F6CDD1D
    lo, hi = s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32)
    m_lo, m_hi = m & 0xFFFFFFFF, m >> 32
    wide = lambda a, b: (a.cast("decimal(38,0)") * F.lit(b).cast("decimal(20,0)"))
    low = wide(lo, m_lo)
    carry = F.floor(low / F.lit(2**32).cast("decimal(20,0)")).cast("decimal(38,0)")
    high = (wide(lo, m_hi) + wide(hi, m_lo) + carry) % F.lit(2**32).cast("decimal(20,0)")
    return s, high.cast("long")


def unit_float(bits: Column) -> Column:
    """A float in [0, 1) from the upper 24 of 32 random bits."""
    return F.shiftright(bits, 8) / F.lit(float(1 << 24))


class MersenneTwister:
    """The 32-bit generator of Matsumoto and Nishimura, and shuffles drawn from it."""

    N, M = 624, 397

    def __init__(self, seed: int):
        s = [seed & 0xFFFFFFFF]
        for i in range(1, self.N):
            s.append((1812433253 * (s[-1] ^ s[-1] >> 30) + i) & 0xFFFFFFFF)
        self.state, self.at = s, self.N

    def next32(self) -> int:
        if self.at == self.N:
            s = self.state
            for i in range(self.N):
                y = (s[i] & 0x80000000) | (s[(i + 1) % self.N] & 0x7FFFFFFF)
                s[i] = s[(i + self.M) % self.N] ^ y >> 1 ^ (0x9908B0DF if y & 1 else 0)
            self.at = 0
        y = self.state[self.at]
        self.at += 1
        y ^= y >> 11
        y ^= y << 7 & 0x9D2C5680
        y ^= y << 15 & 0xEFC60000
        return y ^ y >> 18

    def next64(self) -> int:
        """The first draw gives the high half."""
        return self.next32() << 32 | self.next32()

    def float32(self) -> float:
        return (self.next32() & 0xFFFFFF) / 16777216.0

    def float64(self) -> float:
        return (self.next64() & (1 << 53) - 1) / 9007199254740992.0

    def permutation(self, n: int) -> list[int]:
        """Fisher-Yates from the last place down."""
        a = list(range(n))
        for i in range(n - 1, 0, -1):
            j = self.next32() % (i + 1)
            a[i], a[j] = a[j], a[i]
        return a
