"""WARC archives: writing, normalising monolithic gzip files, and reading by index.

Archives are first written as many crawlers leave them: one gzip stream over the whole file,
in which no record can be reached without inflating all before it. The normaliser inflates
such a stream once, from front to back, writes every record as a gzip member of its own, and
leaves a sidecar index with the offset and length of each member. Records are then read by
their offsets.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from functools import partial
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.texts import byte_rows, prepare
from tokenmill.scratch import drop_path, new_path, stage

LAST = (1 << 63) - 1
MIN_REVISIT_BYTES = 0
_CHUNK = 1 << 20
_HEADER_LIMIT = 1 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit (of page ``refers_to``) has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Inflate:
    """Bytes of a gzip file, inflated once as they are asked for; several members follow each other."""

    def __init__(self, source: BinaryIO):
        self.source, self.held = source, bytearray()
        self.z = zlib.decompressobj(31)
        self.ended = False

    def _more(self) -> bool:
        if self.ended:
            return False
        raw = self.z.unconsumed_tail
        if self.z.eof:
            raw = self.z.unused_data
            self.z = zlib.decompressobj(31)
        raw = raw or self.source.read(_CHUNK)
        if not raw:
            self.ended = True
            return False
        self.held += self.z.decompress(raw, _CHUNK)
        return True

    def upto(self, mark: bytes, limit: int) -> bytes | None:
        """Bytes to the end of the next ``mark``; None at the end of the file."""
        at = 0
        while (end := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > limit:
                raise ValueError("a WARC header has no end")
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.held[: end + len(mark)])
        del self.held[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    first, *rest = head.decode("utf-8", "replace").strip().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and all bytes of each record of a gzip archive, whole-file or by member, one record in memory at a time."""
    stream = _Inflate(source)
    while (head := stream.upto(b"\r\n\r\n", _HEADER_LIMIT)) is not None:
        fields = _fields(head.lstrip(b"\r\n"))
        body = stream.take(int(fields["content-length"]) + 4)
        yield fields, head.lstrip(b"\r\n") + body


def normalise(source: BinaryIO, archive: BinaryIO, index: BinaryIO) -> int:
    """Rewrite each record of ``source`` as a gzip member of its own; the index gets a JSON line for each. Returns their number."""
    at = n = 0
    for fields, raw in records(source):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        archive.write(member)
        index.write(json.dumps({"offset": at, "length": len(member), "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}).encode() + b"\n")
        at += len(member)
        n += 1
    return n


def read_member(archive, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record at an offset of a normalised archive (a random-access file)."""
    archive.seek(offset)
    raw = zlib.decompress(archive.read(length), 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    return fields, block[: int(fields["content-length"])]


def _attempt() -> str:
    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}"


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One whole-file gzip archive for each partition. A repeated attempt writes another file; only the paths of the attempt that counts are returned."""
    out, z, n, path = None, None, 0, f"{folder}/raw-{_attempt()}.warc.gz"
    for b in batches:
        rows = zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), byte_rows(b.column("html")), b.column("refers_to").to_pylist(), strict=True)
        for page_id, url, html, refers_to in rows:
            payload = html or b""
            if out is None:
                f, p = file_system(path)
                f.create_dir(p.rpartition("/")[0], recursive=True)
                out, z = f.open_output_stream(p, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out.write(z.compress(record(page_id, url, payload, digest, refers_to)))
            n += 1
    if out is not None:
        out.write(z.flush())
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n"])


def _normalise(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, path in enumerate(b.column("path").to_pylist()):
            f, p = file_system(path)
            to = f"{folder}/pages-{_attempt()}-{i:04d}.warc.gz"
            g, q = file_system(to)
            g.create_dir(q.rpartition("/")[0], recursive=True)
            with f.open_input_stream(p, compression=None) as source, g.open_output_stream(q, compression=None) as archive, g.open_output_stream(f"{q}.idx", compression=None) as index:
                n = normalise(source, archive, index)
            yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([f"{to}.idx"]), pa.array([n], pa.int64())], ["path", "index", "n"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    number = lambda x: None if x is None else int(x)

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for path, index in zip(b.column("path").to_pylist(), b.column("index").to_pylist(), strict=True):
            f, p = file_system(path)
            g, q = file_system(index)
            rows, held = [], 0
            with f.open_input_file(p) as archive, g.open_input_stream(q, compression=None) as at:
                for line in at.read().splitlines():
                    entry = json.loads(line)
                    fields, block = read_member(archive, entry["offset"], entry["length"])
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"a payload of {path} differs from its digest")
                    rows.append((number(fields.get("warc-x-page-id")), fields.get("warc-target-uri"), size, digest, fields["warc-type"], number(fields.get("warc-x-refers-to-page-id")), payload if fields["warc-type"] == "response" else None))
                    held += len(payload)
                    if held > 8 << 20:
                        yield flush(rows)
                        rows, held = [], 0
            if rows:
                yield flush(rows)


def with_revisits(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, html, refers_to``: of equal payloads of at least so many bytes, all but the smallest page_id refer to it.

    Equality is that of SHA-256 digests. Only ids and digests meet by payload, after a minimum
    for each digest on the map side; html is joined by page_id, which no hot payload skews.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    ids = p.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    ids = ids.where((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull())
    first = ids.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most")).where("most > refers_to").drop("most")
    later = ids.join(first, "sha").where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()
    mine = p.withColumn("sha", F.sha2(F.coalesce("html", F.lit("")), 256))
    return mine.join(later, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write whole-file gzip archives of pages, one for each partition, to a shared folder; returns ``path, n``."""
    prepare(pages, "page_id", "url", "html")
    rows = with_revisits(pages, min_revisit_bytes).mapInArrow(partial(_write, folder=folder), "path string, n long")
    return stage(rows, "warc-raw")[0]


def normalise_archives(paths: DataFrame, folder: str) -> DataFrame:
    """Normalise gzip archives (column ``path``), one task for each; returns ``path, index, n``."""
    n = max(1, paths.count())
    rows = paths.select("path").repartition(n).mapInArrow(partial(_normalise, folder=folder), "path string, index string, n long")
    return stage(rows, "warc-members")[0]


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of normalised archives (``path, index``), each reached by its offset: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``."""
    n = max(1, archives.count())
    return archives.select("path", "index").repartition(n).mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all pages to archives, normalise these, and read every record back (see ``read_archives``).

    Null html is an empty payload; null urls leave out the target, null page_ids are responses
    and nobody's revisit. Rows that repeat page_id and html are alike: all of the smallest
    page_id are responses. An empty table writes no archive and gives no rows; further columns
    are ignored. Revisit records give the size and digest of the payload that they refer to.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    with suppress(OSError):
        f, p = file_system(folder)
        f.create_dir(p, recursive=True)
    raw = write_archives(pages, f"{folder}/raw", min_revisit_bytes)
    members = normalise_archives(raw, f"{folder}/members")
    drop_path(pages.sparkSession, f"{folder}/raw")  # all that they hold is in the members
    return read_archives(members)
