"""Sparse features of documents for the factorisation machines: hashed words, structure statistics and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from sheaf.llm import kernel
from sheaf.llm.fm import Rows

#: Byte classes that are counted: upper case, lower case, digits, white space, line ends, other ASCII, non-ASCII.
_CLASSES = np.full(256, 6, np.uint8)
_CLASSES[:128] = 5
for _low, _high, _c in (("A", "Z", 0), ("a", "z", 1), ("0", "9", 2)):
    _CLASSES[ord(_low) : ord(_high) + 1] = _c
_CLASSES[[9, 11, 12, 13, 32]] = 3
_CLASSES[10] = 4
#: Bins of each statistic, between which it is interpolated.
BINS = 10
#: Value of a term in a row.
WEIGHT = 1.0
STATS = ("upper", "digit", "line", "other", "foreign", "word_length", "distinct", "most_repeated", "log_words", "log_longest", "other_by_word", "upper_of_letters")


def statistics(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, distinct: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A row for each text, a column for each of STATS, all from 0 to 1."""
    counts = np.zeros((7, len(offsets) - 1))
    kinds = _CLASSES[data]
    for c in (0, 1, 2, 4, 5, 6):
        total = np.concatenate([[0], np.cumsum(kinds == c, dtype=np.int32)])
        counts[c] = np.diff(total[offsets])
    size = np.maximum(np.diff(offsets), 1)
    n = np.diff(first)
    word = np.maximum(n, 1)
    letters = np.maximum(counts[0] + counts[1], 1)
    columns = [counts[0] / size, counts[2] / size, counts[4] / size * 10, counts[5] / size * 2, counts[6] / size * 2, size / word / 25, distinct / word, most / word, np.log1p(n) / 12, np.log1p(size / word) / 8, counts[5] / word / 4, counts[0] / letters]
    return np.clip(np.stack(columns, axis=1), 0, 1)


def by_text(keys: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (below 2**32) of each text: the owning text, key and count, ordered by text."""
    both, count = np.unique(owner.astype(np.uint64) << np.uint64(32) | keys.astype(np.uint64), return_counts=True)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64), count


def quality(texts: pa.Array, metadata: list[pa.Array], dims: int) -> Rows:
    """Hashed words (unit length), binned statistics and hashed metadata; dims hashed ones come first, then statistics."""
    data, offsets = kernel.buffers(texts)
    hashes, first, _ = kernel.words(data, offsets)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    text, key, count = by_text(hashes & np.uint64(0xFFFFFFFF), owner, n)  # statistics are of the words, not of hashed ones
    distinct = np.bincount(text, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, text, count)
    stats = statistics(data, offsets, first, distinct, most)
    norm = np.sqrt(np.bincount(text, count.astype(float) ** 2, minlength=n))
    parts = [(text, key % dims, count / norm[text])]
    place = stats * (BINS - 1)
    low = np.minimum(place.astype(int), BINS - 2)
    base = dims + np.arange(len(STATS)) * BINS
    rows = np.repeat(np.arange(n), len(STATS))
    parts.append((rows, (base + low).ravel(), (low + 1 - place).ravel()))
    parts.append((rows, (base + low + 1).ravel(), (place - low).ravel()))
    for k, column in enumerate(metadata):
        values = column.cast(pa.string()).fill_null("\x00")
        d, o = kernel.buffers(pa.compute.binary_join_element_wise(pa.scalar(f"meta{k}x"), pa.compute.replace_substring_regex(values, r"[^A-Za-z0-9]", "z"), ""))
        h, f, _ = kernel.words(d, o)
        parts.append((np.arange(n), (h[f[:-1]] % np.uint64(dims)).astype(np.int64), np.full(n, 0.5)))
    return collect(parts, n)


def terms(texts: pa.Array, dims: int, head: int = 4) -> tuple[Rows, np.ndarray]:
    """Distinct hashed words and hashed beginnings of words (``head`` bytes) of each text, all of one weight, whatever the text's
    length; and the number of words of each text."""
    data, offsets = kernel.buffers(texts)
    hashes, first, heads = kernel.words(data, offsets, head)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    both = np.concatenate([hashes, heads]) % np.uint64(dims)
    text, key, count = by_text(both, np.concatenate([owner, owner]), n)
    parts = [(text, key, np.full(len(text), WEIGHT)), (np.arange(n), np.full(n, dims), np.full(n, 0.1))]
    return collect(parts, n), np.diff(first)


def collect(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> Rows:
    row, index, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    return Rows(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), index[order].astype(np.int32), value[order].astype(np.float32))
