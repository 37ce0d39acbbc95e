"""Exact deduplication over a cuckoo-filter index of content digests.

The index is bucketed by digest: each bucket has a cuckoo filter of the live digests' fingerprints and the keys themselves
(SHA-256, the id of the document kept, how many documents are live under it).  A lookup asks the filter; a hit is verified
against the bucket's keys, so that a fingerprint shared by chance costs a lookup and no document.  A filter that overflows is
doubled and filled again from the bucket's keys.  Every task first dedups its own rows over an index of its own, so that of a
content with ever so many copies only a row for each task reaches its bucket.  Only digests, ids and counts are shuffled.  The
content of documents that do hit is then compared byte by byte, in a second shuffle that carries the text of those alone.

A digest is live as long as one of its documents is: deleting a document takes one off its count, whichever document it is, and
the digest goes with the last one.  Until then it is known by the id that it was first kept under.  Documents must be deleted
once at most, as the index has counts, not lists of ids.

Cases: a null text is no content; such a document is kept and is no copy of another.  Empty texts are equal to one another.
Of equal texts the one with the least ``doc_id`` is kept (null ids count as greater than all).  Repeated rows are copies of
one another, also under one id.  An empty table gives no rows.  Other columns are never read by the index.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import common, kernel

#: Up to so many verified digests are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
SLOTS = 4
KICKS = 200
#: Digests that a task dedups before it sends them on.
HELD = 1 << 16


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints together with the live keys it stands for."""

    def __init__(self, buckets: int = 16) -> None:
        self.keys: dict[bytes, list] = {}  # the id that is kept, how many are live, how many of them have that id
        self.resizes = 0
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots: list[list[int]] = [[] for _ in range(buckets)]

    @staticmethod
    def _print(digest: bytes) -> int:
        return (digest[8] << 8 | digest[9]) or 1

    def _homes(self, digest: bytes, mark: int) -> tuple[int, int]:
        i = int.from_bytes(digest[:8], "little") & self.mask
        return i, self._other(i, mark)

    def _other(self, i: int, mark: int) -> int:
        return (i ^ (mark * 0x5BD1E995)) & self.mask

    def maybe(self, digest: bytes) -> bool:
        """What the filter alone says; may err by saying yes."""
        mark = self._print(digest)
        i, j = self._homes(digest, mark)
        return mark in self.slots[i] or mark in self.slots[j]

    def find(self, digest: bytes) -> tuple[bool, int | None]:
        """Whether the digest is live, and under which id: a hit of the filter, verified against the keys."""
        if not self.maybe(digest) or digest not in self.keys:
            return False, None
        return True, self.keys[digest][0]

    def insert(self, digest: bytes, doc_id: int | None, n: int = 1, same: int = 1) -> bool:
        """Adds ``n`` documents, ``same`` of them under this id; False if the digest was live already."""
        if self.find(digest)[0]:
            self.keys[digest][1] += n
            self.keys[digest][2] += same if self.keys[digest][0] == doc_id else 0
            return False
        self.keys[digest] = [doc_id, n, same]
        if not self._place(digest):
            self._grow()
        return True

    def _place(self, digest: bytes) -> bool:
        mark = self._print(digest)
        i, j = self._homes(digest, mark)
        for k in (i, j):
            if len(self.slots[k]) < SLOTS:
                self.slots[k].append(mark)
                return True
        for kick in range(KICKS):
            home = self.slots[i]
            mark, home[kick % SLOTS] = home[kick % SLOTS], mark
            i = self._other(i, mark)
            if len(self.slots[i]) < SLOTS:
                self.slots[i].append(mark)
                return True
        return False

    def _grow(self) -> None:
        """Doubles the filter, until the stored keys all find room."""
        size = self.mask + 1
        while True:
            size *= 2
            self.resizes += 1
            self._reset(size)
            if all(map(self._place, self.keys)):
                return
            if size > 64 * (len(self.keys) + 16):  # more equal fingerprints than two homes hold, whatever the size
                raise ValueError("digests aren't evenly distributed")

    def delete(self, digest: bytes) -> bool:
        """Takes a document off a live digest, which is dead after the last; False if it wasn't live."""
        if not self.find(digest)[0]:
            return False
        self.keys[digest][1] -= 1
        if self.keys[digest][1] > 0:
            return True
        mark = self._print(digest)
        i, j = self._homes(digest, mark)
        self.slots[i if mark in self.slots[i] else j].remove(mark)
        del self.keys[digest]
        return True

    def to_bytes(self) -> bytes:
        return struct.pack("<I", self.mask + 1) + b"".join(d + struct.pack("<?qqq", i is None, i or 0, n, m) for d, (i, n, m) in self.keys.items())

    @classmethod
    def from_bytes(cls, stored: bytes) -> CuckooIndex:
        index = cls(struct.unpack_from("<I", stored)[0])
        for at in range(4, len(stored), 57):
            none, i, n, m = struct.unpack_from("<?qqq", stored, at + 32)
            index.insert(stored[at : at + 32], None if none else i, n, m)
        return index


RESULT = "bucket int, op int, digest binary, doc_id bigint, first_id bigint, n bigint, same bigint"
_RESULT = pa.schema([("bucket", pa.int32()), ("op", pa.int32()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("first_id", pa.int64()), ("n", pa.int64()), ("same", pa.int64())])
INSERT, DELETE, COPY, INDEX = 0, 1, 2, -1


def _first_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (digest, doc_id) one for each digest: its least id, how many rows there are, and how many of that id."""

    def listed(index: CuckooIndex) -> pa.RecordBatch:
        kept = list(index.keys.values())
        return pa.RecordBatch.from_arrays([pa.array(index.keys, pa.binary()), *(pa.array([k[i] for k in kept], pa.int64()) for i in range(3))], names=["digest", "doc_id", "n", "same"])

    index = CuckooIndex(1 << 10)
    for b in batches:
        for digest, doc_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not index.insert(digest, doc_id):
                key = index.keys[digest]
                if doc_id is not None and (key[0] is None or doc_id < key[0]):
                    key[0], key[2] = doc_id, 1
        if len(index.keys) >= HELD:
            yield listed(index)
            index = CuckooIndex(1 << 10)
    if index.keys:
        yield listed(index)


def _apply(emit_index: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, index = None, CuckooIndex()
        for batch in batches:
            out: list[list] = [[] for _ in _RESULT]
            for b, op, digest, doc_id, n, same in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "op", "digest", "doc_id", "n", "same")), strict=True):
                if b != bucket:
                    if emit_index and bucket is not None:
                        for column, x in zip(out, (bucket, INDEX, index.to_bytes(), None, None, None, None), strict=True):
                            column.append(x)
                    bucket, index = b, CuckooIndex()
                if op == INDEX:
                    index = CuckooIndex.from_bytes(digest)
                    continue
                live, first = index.find(digest)
                if op == DELETE:
                    index.delete(digest)
                elif index.insert(digest, doc_id, n, same):
                    first = doc_id
                else:
                    op = COPY  # a verified hit
                for column, x in zip(out, (b, op, digest, doc_id, first, n, same), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, _RESULT, strict=True)], schema=_RESULT)
        if emit_index and bucket is not None:
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "op": INDEX, "digest": index.to_bytes()}], schema=_RESULT)

    return run


def digests(docs: DataFrame) -> DataFrame:
    """(digest, doc_id) of every document that has a text."""
    return common.own(docs, "doc_id", "text").where(F.col("text").isNotNull()).select(F.unhex(F.sha2("text", 256)).alias("digest"), F.col("doc_id").cast("bigint"))


def change(keys: DataFrame, index: DataFrame | None = None, delete: bool = False, buckets: int = 0, emit_index: bool = True) -> DataFrame:
    """Inserts or deletes the rows of ``keys`` (digest, doc_id, and maybe n and same: so many rows), in the order of their ids.

    ``index`` is what an earlier call returned in its rows of op -1 (None: an empty index); it must have the same number
    of ``buckets``.  Rows of the result: op 0 a digest that became live, 2 a copy of ``first_id`` (null: of a row with a null
    id), 1 a deletion of a document from those under ``first_id`` (null: none was live), -1 a bucket of the new index."""
    n = buckets or common.partitions(keys.sparkSession)
    counts = [F.col(c) if c in keys.columns else F.lit(1).cast("bigint").alias(c) for c in ("n", "same")]
    rows = keys.select(F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("bucket"), F.lit(DELETE if delete else INSERT).alias("op"), "digest", "doc_id", *counts)
    if index is not None:
        rows = rows.unionByName(index.where(F.col("op") == INDEX).select("bucket", "op", "digest", "doc_id", "n", "same"))
    placed = common.placed(rows, "bucket", n).sortWithinPartitions("bucket", F.col("op") != INDEX, F.col("doc_id").asc_nulls_last())
    return placed.transform(kernel.arrow, _apply(emit_index), RESULT)


def copies(docs: DataFrame, listed: DataFrame, buckets: int = 0) -> DataFrame:
    """(digest, first_id, same) of contents that several rows have, compared with one another: the document that is kept, and how
    many rows it has.  ``listed`` has the rows' digests."""
    local = listed.transform(kernel.arrow, _first_here, "digest binary, doc_id bigint, n bigint, same bigint")
    found = change(local, buckets=buckets, emit_index=False)
    hits = found.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("same"))).alias("same"))
    hits = common.cut(hits.where("n > 1").select("digest", "first_id", "same"))
    wanted = hits.select("digest")
    if hits.count() <= BROADCAST_DIGESTS:
        wanted = F.broadcast(wanted)
    content = common.own(docs, "text").where(F.col("text").isNotNull()).withColumn("digest", F.unhex(F.sha2("text", 256))).join(wanted, "digest", "left_semi")
    same = content.groupBy("digest").agg((F.min("text") == F.max("text")).alias("equal")).where("equal").select("digest")
    return common.cut(hits.join(same, "digest", "left_semi"))


def exact_dedup(docs: DataFrame, buckets: int = 0) -> DataFrame:
    """A row for each document: ``first_id``, the document it is a copy of (itself if none), and ``keep``."""
    listed = common.cut(digests(docs))
    found = copies(docs, listed, buckets)
    small = found.count() <= BROADCAST_DIGESTS
    of = found.select(F.col("digest").alias("d"), "first_id", F.lit(True).alias("copied"))
    joined = listed.join(F.broadcast(of) if small else of, F.col("digest") == F.col("d"), "left")
    itself = F.col("copied").isNull()
    rest = joined.where(itself | ~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", F.when(itself, F.col("doc_id")).otherwise(F.col("first_id")).alias("first_id"), itself.alias("keep"))
    # Of the rows of the document that is kept, which may be repeated, one stays.
    kept = found.select(F.col("first_id").alias("doc_id"), "first_id", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))).alias("k")).select("doc_id", "first_id", (F.col("k") == 1).alias("keep"))
    none = common.own(docs, "doc_id", "text").where(F.col("text").isNull()).select(F.col("doc_id").cast("bigint")).select("doc_id", F.col("doc_id").alias("first_id"), F.lit(True).alias("keep"))
    return rest.unionByName(kept).unionByName(none)


def drop_copies(docs: DataFrame, buckets: int = 0) -> DataFrame:
    """The documents without their copies, all columns as they were."""
    found = copies(docs, digests(docs), buckets)
    small = found.count() <= BROADCAST_DIGESTS
    mark = "__digest"
    while mark in docs.columns:
        mark += "_"
    rows = docs.withColumn(mark, F.unhex(F.sha2("text", 256)))
    key = found.select(F.col("digest").alias(mark + "d"), F.col("first_id").alias(mark + "i"), F.col("same").alias(mark + "n"))
    joined = rows.join(F.broadcast(key) if small else key, rows[mark] == key[mark + "d"], "left").where(F.col(mark + "d").isNull() | F.col("doc_id").eqNullSafe(F.col(mark + "i")))
    once = joined.where(F.coalesce(F.col(mark + "n"), F.lit(1)) <= 1)
    if found.where("same > 1").isEmpty():
        return once.select(*docs.columns)
    repeated = joined.where(F.col(mark + "n") > 1).dropDuplicates([mark])  # rows repeated under one id: one of them stays
    return once.unionByName(repeated).select(*docs.columns)
