"""Column builders over the UTF-8 bytes of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_bytes(text: str | Column) -> Column:
    return F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")


def byte_at(b: Column, i: Column) -> Column:
    """The byte at a 1-based place, 0 to 255."""
    return F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int")


def byte_array(b: Column) -> Column:
    """All bytes as an array of 0 to 255 (empty for no bytes)."""
    n = F.octet_length(b)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: byte_at(b, i))).otherwise(F.array().cast("array<int>"))


def windows(b: Column, n: int) -> Column:
    """All windows of n bytes, in order."""
    most = F.octet_length(b) - (n - 1)
    return F.when(most > 0, F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.substring(b, i, F.lit(n)))).otherwise(F.array().cast("array<binary>"))


def pack_le(b: Column) -> Column:
    """Up to 8 bytes as a little-endian BIGINT; the eighth byte sets the sign bit."""
    parts = [F.when(F.octet_length(b) > i, F.shiftleft(byte_at(b, F.lit(i + 1)).cast("long"), 8 * i)).otherwise(F.lit(0).cast("long")) for i in range(8)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def unpack_le(x: Column, n: Column) -> Column:
    """The n bytes of a little-endian BIGINT, as upper-case hex."""
    pairs = [F.lpad(F.hex(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)]
    return F.substring(F.concat(*pairs), F.lit(1), n * 2)


def positional_features(b: Column) -> Column:
    """``place * 256 + byte`` for each byte of a gram."""
    return F.transform(byte_array(b), lambda x, i: i * 256 + x)


def printable(b: Column) -> Column:
    """Whether a token prints: not a single byte that is neither printable nor white space."""
    one = byte_at(b, F.lit(1))
    single = F.octet_length(b) == 1
    shown = one.between(32, 126) | one.between(9, 13)
    return (F.octet_length(b) > 0) & (~single | shown)
