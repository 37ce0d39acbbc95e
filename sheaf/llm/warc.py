"""A content-addressed archive of WARC records.

A record is an exact header (all bytes up to and with the empty line) and a block.  The payload is the block; of a ``response`` record
in HTTP it is what follows the HTTP header, which is kept apart (dates and cookies in it would keep equal pages from sharing).
The archive has two tables: ``payloads`` (digest, payload), every content once under its SHA-256, and ``headers`` (record_id,
header, http, digest, length).  The digest is always computed from the bytes; those that the header declares, of the block or
of the payload, are checked against them.  A record is made again by joining the two by digest; what comes out of the store is
hashed again, and its length compared, so that a damaged payload is found.  Both tables are partitioned by digest, so payloads
are shuffled once for storing and reading back together; of many copies a task sends one.

Cases: a null payload is no content: its record keeps its header alone, and comes back with a null payload; an empty payload
is content like any other.  Null ids and repeated records are kept, a row each.  Of declared digests only ``sha256`` ones in
hexadecimal are checked.  An HTTP header that doesn't end is all header, before an empty payload.  Empty tables give empty
archives.  Other columns are never read.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm import common, kernel

END = b"\r\n\r\n"


def header(page_id: Column, url: Column, payload: Column) -> Column:
    """The header of a resource record for a page."""
    fields = [
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:"), F.coalesce(F.sha2(payload, 256), F.lit("")),
        F.lit("\r\nContent-Length: "), F.coalesce(F.octet_length(payload), F.lit(0)).cast("string"), F.lit("\r\n\r\n"),
    ]
    return F.concat(*fields).cast("binary")


def records(pages: DataFrame) -> DataFrame:
    """(record_id, header, payload) of pages (page_id, url, html)."""
    p = common.own(pages, "page_id", "url", "html").select(F.col("page_id").cast("bigint").alias("record_id"), "url", F.col("html").cast("binary").alias("payload"))
    return p.select("record_id", header(F.col("record_id"), F.col("url"), F.col("payload")).alias("header"), "payload")


def _http(header_: Column, block: Column) -> Column:
    """How many bytes of the block are an HTTP header."""
    h = header_.cast("string")
    response = h.rlike(r"(?i)\r\nWARC-Type:[ \t]*response\r\n") & h.rlike(r"(?i)\r\nContent-Type:[ \t]*application/http")
    end = F.locate("\r\n\r\n", F.decode(block, "ISO-8859-1"))  # a character for each byte
    return F.when(response, F.when(end > 0, end + 3).otherwise(F.octet_length(block))).otherwise(0)


def _declared(header_: Column, what: str) -> Column:
    """The digest that a header declares of what is named; empty if none."""
    return F.regexp_extract(header_.cast("string"), rf"(?i)\r\nWARC-{what}-Digest:[ \t]*sha256:([0-9a-fA-F]{{64}})\r\n", 1)


def store(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The archive's (payloads, headers) of records (record_id, header, payload: the whole block).  In headers, ``declared_ok`` says
    whether the declared digests are those of the bytes (null: none is declared)."""
    r = common.own(recs, "record_id", "header", "payload").withColumn("n", _http(F.col("header"), F.col("payload")))
    r = r.select("record_id", "header", F.col("payload").alias("block"), F.when(F.col("n") > 0, F.expr("substring(payload, 1, n)")).alias("http"), F.expr("substring(payload, n + 1)").alias("payload"))
    r = r.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    payloads = r.where(F.col("payload").isNotNull()).select("digest", "payload").dropDuplicates(["digest"])
    of_block, of_payload = _declared(F.col("header"), "Block"), _declared(F.col("header"), "Payload")
    ok = ((of_block == "") | (F.lower(of_block) == F.sha2("block", 256))) & ((of_payload == "") | (F.lower(of_payload) == F.lower(F.hex("digest"))))
    headers = r.select("record_id", "header", "http", "digest", F.octet_length("payload").cast("bigint").alias("length"), F.when((of_block != "") | (of_payload != ""), ok).alias("declared_ok"))
    return payloads, headers


def restore(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """(record_id, header, payload, digest, length, verified, declared_ok): the records with their whole blocks, and whether the stored
    bytes have the digest and the length that they are kept under (null payloads: whether there were none)."""
    p = payloads.select(F.col("digest").alias("d"), F.col("payload"))
    joined = headers.join(p, headers["digest"] == p["d"], "left")
    intact = F.when(F.col("digest").isNull(), F.col("payload").isNull()).otherwise(F.coalesce((F.unhex(F.sha2("payload", 256)) == F.col("digest")) & (F.octet_length("payload") == F.col("length")), F.lit(False)))
    block = F.when(F.col("http").isNull(), F.col("payload")).otherwise(F.concat("http", "payload"))
    return joined.select("record_id", "header", block.alias("payload"), "digest", "length", intact.alias("verified"), "declared_ok")


def archive(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The archive's tables, written to the shared folder and read again."""
    payloads, headers = store(recs)
    return common.written(payloads), common.written(headers)


def round_trip(recs: DataFrame) -> DataFrame:
    """A row for each record that went through the archive: (record_id, digest, length, record_sha256, verified, declared_ok);
    ``record_sha256`` is that of header and block together, as made again."""
    whole = F.sha2(F.concat("header", F.coalesce("payload", F.lit(b""))), 256)
    return restore(*archive(recs)).select("record_id", F.lower(F.hex("digest")).alias("digest"), "length", whole.alias("record_sha256"), "verified", "declared_ok")


def _unzipped(data: bytes) -> bytes:
    """The members of a gzip file, end to end; of a member that is cut off or damaged what comes before, and nothing after it."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            for low in range(0, len(data), 1 << 16):
                out.append(z.decompress(data[low : low + (1 << 16)]))
                if z.eof:
                    data = z.unused_data + data[low + (1 << 16) :]
                    break
            else:
                break
        except zlib.error:
            break
    return b"".join(out)


_NEXT = re.compile(rb"^WARC/\d", re.M)


def split(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a WARC file, plain or gzipped.  Of a record that the file cuts off there is what there
    is; a last header that doesn't end is one without a block.  Without a valid Content-Length the block goes on to the next
    line that begins a record."""
    if data[:2] == b"\x1f\x8b":
        data = _unzipped(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(END, at)
        if end < 0:
            yield data[at:], b""
            return
        head = data[at : end + len(END)]
        length = None
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
        begin = end + len(END)
        if length is None:
            m = _NEXT.search(data, begin)
            at = m.start() if m else len(data)
            block = data[begin:at]
            yield head, block[: len(block) - len(END)] if block.endswith(END) else block.rstrip(b"\r\n") if not block.strip() else block
            continue
        at = begin + length
        yield head, data[begin:at]


def read(files: DataFrame) -> DataFrame:
    """(path, position, record_id, header, payload) of WARC files, given as (path, content) like binaryFile's; record_id is a
    hash of path and position."""
    schema = pa.schema([("path", pa.string()), ("position", pa.int64()), ("header", pa.binary()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, (head, body) in enumerate(split(content or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([i], pa.int64()), pa.array([head], pa.binary()), pa.array([body], pa.binary())], schema=schema)

    rows = common.own(files, "path", "content").transform(kernel.arrow, run, "path string, position bigint, header binary, payload binary")
    return rows.select("path", "position", F.xxhash64("path", "position").alias("record_id"), "header", "payload")


def write(recs: DataFrame) -> DataFrame:
    """(record_id, member): each record as a member of a gzipped WARC file; the members of a file may be joined end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = [gzip.compress((h or b"") + (p or b"") + END, mtime=0) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(members, pa.binary())], names=["record_id", "member"])

    return common.own(recs, "record_id", "header", "payload").transform(kernel.arrow, run, "record_id bigint, member binary")
