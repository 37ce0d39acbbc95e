"""Vectorised text kernel shared by the operators of this subpackage.

Words are maximal runs of ASCII letters, ASCII digits and non-ASCII characters, and are given to the kernel lower-cased.
Everything here works on the UTF-8 buffers of Arrow string arrays, so that no Python string is made per word.  A word's
64-bit hash is a polynomial over its bytes (mod 2**64) passed through a finaliser; hashes depend on nothing but the word.
Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes handled at once; a single word that is longer is handled whole.
CHUNK = 1 << 18

#: Bytes of an Arrow batch on its way to a worker.
BATCH_BYTES = 4 << 20
_BOUND = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")  # Spark's own bound

_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[ord("0") : ord("9") + 1] = WORD_BYTE[ord("a") : ord("z") + 1] = WORD_BYTE[ord("A") : ord("Z") + 1] = True
WORD_BYTE[128:] = True
_BYTE_CODE = np.where(WORD_BYTE, np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64), np.uint64(0))
_BYTE_CODE[ord("A") : ord("Z") + 1] = _BYTE_CODE[ord("a") : ord("z") + 1]  # ASCII case makes no difference
_tables = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the radix and of its inverse, at least ``n`` of each; kept by the worker."""
    if len(_tables[0]) < n:
        for i, base in enumerate((_RADIX, _RADIX_INVERSE)):
            step = np.full(n, base, dtype=np.uint64)
            step[0] = 1
            _tables[i] = np.multiply.accumulate(step)
    return _tables


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one offset more than there are texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, the first word of each text (one more entry than texts), and the hashes of the words'
    first ``prefix`` bytes (empty for 0)."""
    hashes, heads, at = [], [], []
    where, n, cuts = 0, len(data), offsets[1:-1]
    while where < n:
        stop = min(n, where + CHUNK)
        while stop < n and WORD_BYTE[data[stop]] and WORD_BYTE[data[stop - 1]]:  # cut between words
            stop += 1
        part = data[where:stop]
        inside = WORD_BYTE[part]
        edge = np.empty(len(part) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
        bounds = np.flatnonzero(edge)
        here = cuts[np.searchsorted(cuts, where, "right") : np.searchsorted(cuts, stop, "left")] - where
        if len(here):  # a text that ends in a word and one that begins with a word aren't one word
            here = np.unique(here)
            here = here[inside[here] & inside[here - 1]]
            bounds = np.sort(np.concatenate([bounds, here, here]))
        starts, ends = bounds[::2], bounds[1::2]
        if len(starts):
            forward, back = _powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODE[part] * forward[: len(part)], out=sums[1:])
            hashes.append(mix((sums[ends] - sums[starts]) * back[starts]))
            at.append(starts + where)
            if prefix:
                heads.append(mix((sums[np.minimum(ends, starts + prefix)] - sums[starts]) * back[starts] + np.uint64(prefix)))
        where = stop
    none = np.zeros(0, np.uint64)
    begin = np.concatenate(at) if at else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else none, np.searchsorted(begin, offsets, "left"), np.concatenate(heads) if heads else none


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words within each text, in order, and the first run of each text.  A text of fewer words
    has one run of all of them; a text without words has none."""
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    start = np.concatenate([[0], np.cumsum(runs)])
    if not len(hashes):
        return np.zeros(0, np.uint64), start
    begin = np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], runs)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    left = np.repeat(np.minimum(count, n), runs)
    out = left.astype(np.uint64)
    for i in range(n):
        more = out * np.uint64(0xD6E8FEB86659FD93) + padded[begin + i]
        out = more if i == 0 else np.where(left > i, more, out)  # a short run's hash doesn't depend on n
    return mix(out), start


def slices(batch: pa.RecordBatch, text: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``size`` bytes of text, so that memory doesn't depend on the batch's size."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Gives memory that isn't in use back to the system: a worker that waits for its next task holds none."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def arrow(df: DataFrame, run: Run, schema: str) -> DataFrame:
    """mapInArrow, giving memory back at the end of each task.

    Batches are bounded by their bytes, as texts differ in length: a session that has no bound of its own (Spark's is far
    above what a worker should hold) gets ``BATCH_BYTES``."""
    conf = df.sparkSession.conf
    if conf.get(_BOUND[0]) == _BOUND[1]:
        conf.set(_BOUND[0], f"{BATCH_BYTES}b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)
