import base64
import gzip
import hashlib
import io
import json

from tokenmill.llm.warc import normalise, read_member, record, records, round_trip


def test_round_trip(spark, tmp_path):
    big = "é" * 400_000
    rows = [(5, "http://a/ü\n", "<p>x"), (2, "http://b", "<p>x"), (9, None, "<p>x"), (4, "u", None), (3, "u", ""), (7, "u", big), (None, "u", "<p>x"), (11, "u", "lone"), (2, "http://b", "<p>x")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int").repartition(3)
    got = round_trip(pages, str(tmp_path / "w")).collect()
    first = {"<p>x": 2, "": 3, big: 7, "lone": 11}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        of = first[h or ""]
        revisit = i is not None and i != of
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", of if revisit else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)
    assert {bytes(r.payload) for r in got if r.page_id == 7} == {big.encode()}


def test_small_payloads_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in round_trip(pages, str(tmp_path / "x"), 3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert round_trip(pages.limit(0), str(tmp_path / "y")).count() == 0


def test_normaliser_takes_whole_files_and_members():
    raw = [record(i, f"u{i}", b"payload \r\n\r\n" * i, "D") for i in range(5)]
    for source in (gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw))):
        archive, index = io.BytesIO(), io.BytesIO()
        assert normalise(io.BytesIO(source), archive, index) == 5
        entries = [json.loads(x) for x in index.getvalue().splitlines()]
        assert gzip.decompress(archive.getvalue()) == b"".join(raw)
        fields, block = read_member(archive, entries[3]["offset"], entries[3]["length"])
        assert fields["warc-x-page-id"] == "3" and block.endswith(b"payload \r\n\r\n" * 3)
        assert [f["warc-x-page-id"] for f, _ in records(io.BytesIO(archive.getvalue()))] == list("01234")
