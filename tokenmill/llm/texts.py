"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql.types import StructField, StructType

#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 3_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SPACE = b" \t\n\r\x0b\x0c"


def byte_rows(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string or binary Arrow column, one row at a time without copying the batch."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    for x in column.cast(kind):
        yield x.as_py()


def word_blocks(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """Lists of words that together are ``data.split()``, from blocks of bounded size.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D.
    """
    at, n = 0, len(data)
    while at < n:
        end = at + size
        if end >= n:
            yield data[at:].split()
            return
        cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:  # a word longer than a block: go on to its end
            while end < n and data[end] not in _SPACE:
                end += 1
            cut = end
        yield data[at:cut].split()
        at = cut


def free_names(docs, *names: str) -> list[str]:
    """Names like those given that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n in taken:
            n += "_"
        out.append(n)
    return out


def prepare(docs, *names: str) -> None:
    """Raise if a needed column is missing; and see to it that Arrow batches of texts stay small.

    Spark sends 10,000 rows at a time to Python by default. At some kilobytes a text, several
    workers then hold more than they need; a smaller setting of the session stays as it is.
    """
    conf = docs.sparkSession.conf
    if int(conf.get(_BATCH, "10000")) > BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    missing = [n for n in names if n not in docs.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def _named(batches: Iterator[pa.RecordBatch], step, names: list[str], given: list[str]) -> Iterator[pa.RecordBatch]:
    for b in step(pa.RecordBatch.from_arrays(x.columns, names) for x in batches):
        yield pa.RecordBatch.from_arrays(b.columns, given)


def map_rows(docs, step, schema: StructType):
    """``docs.mapInArrow(step, schema)``, for columns of any name: those with dots aren't found otherwise."""
    given = [f"c{i}" for i in range(len(schema))]
    kinds = StructType([StructField(n, f.dataType) for n, f in zip(given, schema.fields, strict=True)])
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return safe.mapInArrow(partial(_named, step=step, names=docs.columns, given=given), kinds).toDF(*schema.names)
