from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import functions as F

from sheaf.llm import warc


def _rows(df, *columns):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*columns).collect()), key=repr)


def _pages(spark):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, "u3", ""), (4, None, "ünï\r\n\r\nx"), (5, "u5", None), (None, "u6", "z" * 300_000), (1, "u1", "same"), (7, "u7", "")]
    return spark.createDataFrame([(*r, "d", "h") for r in rows], "page_id bigint, url string, html string, digest string, header string")


def test_records_come_back_exactly(spark):
    recs = warc.records(_pages(spark))
    payloads, headers = warc.store(recs)
    assert payloads.count() == 4 and headers.count() == 8  # same, empty, one more text, the long one
    back = warc.restore(payloads, headers)
    assert _rows(back, "record_id", "header", "payload") == _rows(recs, "record_id", "header", "payload")
    assert back.where("verified").count() == 8


def test_whole_round_trip_against_brute_force(spark):
    recs = warc.records(_pages(spark))
    want = sorted(((i, None if p is None else hashlib.sha256(p).hexdigest(), hashlib.sha256(h + (p or b"")).hexdigest(), True) for i, h, p in _rows(recs, "record_id", "header", "payload")), key=repr)
    assert _rows(warc.round_trip(recs), "record_id", "digest", "record_sha256", "verified") == want


def test_damage_is_found(spark):
    payloads, headers = warc.store(warc.records(_pages(spark)))
    bad = payloads.withColumn("payload", F.when(F.octet_length("payload") == 4, F.lit(b"sane")).otherwise(F.col("payload")))
    assert {r["record_id"] for r in warc.restore(bad, headers).where("not verified").collect()} == {1, 2}
    lost = payloads.where("octet_length(payload) <> 4")
    assert {r["record_id"] for r in warc.restore(lost, headers).where("not verified").collect()} == {1, 2}
    lie = warc.records(_pages(spark)).withColumn("payload", F.when(F.col("record_id") == 2, F.lit(b"other")).otherwise(F.col("payload")))
    assert {r["record_id"] for r in warc.store(lie)[1].where("not declared_ok").collect()} == {2}


def test_files(spark, tmp_path):
    recs = warc.records(_pages(spark).where("html is not null"))
    members = [bytes(r["member"]) for r in warc.write(recs).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "b.warc").write_bytes(b"".join(map(gzip.decompress, members)))
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read(spark.read.format("binaryFile").load(str(tmp_path)))
    assert got.count() == 14
    assert _rows(got.where("path like '%.gz'"), "header", "payload") == _rows(recs, "header", "payload") == _rows(got.where("path like '%b.warc'"), "header", "payload")
    assert list(warc.split(b"WARC/1.0\r\nX: 1\r\n\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\nshort")) == [(b"WARC/1.0\r\nX: 1\r\n\r\n", b""), (b"WARC/1.0\r\nContent-Length: 9\r\n\r\n", b"short")]


def test_empty(spark):
    none = warc.records(_pages(spark).where("false"))
    assert warc.round_trip(none).count() == 0 and warc.store(none)[0].count() == 0


def test_damaged_files():
    one, two = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"WARC/1.0\r\nContent-Length: 400\r\n\r\n" + bytes(range(200)) * 2 + b"\r\n\r\n"
    zipped = gzip.compress(one) + gzip.compress(two)
    assert [p for _, p in warc.split(zipped)] == [b"abc", bytes(range(200)) * 2]
    cut = [p for _, p in warc.split(zipped[:-40])]
    assert cut[0] == b"abc" and len(cut) == 2 and (bytes(range(200)) * 2).startswith(cut[1])
    assert [p for _, p in warc.split(gzip.compress(one) + b"\x1f\x8b garbage")] == [b"abc"]
    assert list(warc.split(one + b"WARC/1.0\r\nX: 1\r\n")) == [(b"WARC/1.0\r\nContent-Length: 3\r\n\r\n", b"abc"), (b"WARC/1.0\r\nX: 1\r\n", b"")]
    for length in (b"", b"Content-Length: x\r\n"):
        head = b"WARC/1.0\r\n" + length + b"\r\n"
        assert list(warc.split(head + b"some body\r\n\r\n" + one)) == [(head if length else b"WARC/1.0\r\n\r\n", b"some body"), (b"WARC/1.0\r\nContent-Length: 3\r\n\r\n", b"abc")]


def test_http_responses_share_their_payloads(spark):
    def record(i: int, date: str, body: bytes, kind: str = "response", sep: bytes = b"\r\n\r\n", declared: bytes | None = None) -> tuple:
        block = b"HTTP/1.1 200 OK\r\nDate: " + date.encode() + sep + body
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body if declared is None else declared).hexdigest()}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
        return i, bytearray(head.encode()), bytearray(block)

    rows = [record(1, "Mon", b"page \xff\x00"), record(2, "Tue", b"page \xff\x00"), record(3, "Wed", b"other"), record(4, "Thu", b"page \xff\x00", "request"), record(5, "Fri", b"", sep=b""), record(6, "Sat", b"page \xff\x00", declared=b"x")]
    recs = spark.createDataFrame(rows, "record_id bigint, header binary, payload binary")
    payloads, headers = warc.archive(recs)
    assert payloads.count() == 4 and {r["record_id"]: r["declared_ok"] for r in headers.collect()} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False}
    back = warc.restore(payloads, headers)
    assert _rows(back, "record_id", "header", "payload") == _rows(recs, "record_id", "header", "payload") and back.where("verified").count() == 6
