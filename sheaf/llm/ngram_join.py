"""N-gram Jaccard join: pairs of documents whose sets of word n-grams have a Jaccard similarity of at least ``threshold``.

A prefix-filtered self join under several global token orders.  A set of size s can reach the threshold t only with sets
that share one of its first ``s - ceil(t s) + 1`` tokens, under *any* total order of all tokens.  Every order used here
puts tokens of one set only (document frequency 1) first: they can't be shared, so a set with that many of them is done
without a look at any other.  The orders differ among shared tokens: order A is by frequency, rare ones first, B and C are by
two further hashes.  Candidates share a prefix token under A, under B and under C, and their sizes pass the length bound; the
whole token sets of these alone are then moved, and intersected exactly.

Plan, each step one shuffle on even keys:
1. first scan: a name and a size for every document's set; tokens that more than a ``SHARE`` of all occurrences are of (at
   most 2 / SHARE of them, a few MB) and texts of which there are many copies are found.  These hot ones go the way of no
   other: the tokens are last in order A and aren't gathered, of the texts only one document is tokenised;
2. second scan: n-gram hashes (numpy on Arrow buffers) go to the token bucket of their hash, packed in blobs; by token bucket
   document frequencies are counted, and shared tokens go to the bucket of their set; there prefixes are cut.  Sets that can't
   have a partner go, the others are kept by a checkpoint;
3. every A-prefix token has as pivot the least set that has it in its prefix.  Two sets that share such a token share its
   pivot, so sets meet under pivots: near copies gather under one without a row for each pair.  A pair that shares several
   pivots is judged under the least;
4. the sets of a pivot are cut into tiles of ``TILE``, a unit for each two tiles.  Units get sizes and prefixes (24-bit
   fingerprints, which may add candidates and lose none), and keep the pairs that pass the filters of all three orders;
5. units get the tokens of what is left in them, and verify those pairs.

Of a unit come out the numbers of links of its sets, and a spanning forest of its links, so results grow with the documents and
not with the pairs.  Sets are named by 96 bits; tokens are told apart by
40 bits and their bucket, so that two of one pair of documents of 500 words are mixed up with a chance of about 10**-9 at 100 buckets.

``classes`` has a row for each document: ``class_id`` is the least document that it is linked to directly or through others
(by equal sets or by Jaccard), ``links`` the number of other sets that reach the threshold with its own, ``copies`` the number
of other documents with the same set.  ``pairs`` has the pairs of different sets, as the least document of each.

Cases: null and empty texts, and texts without a word, have no n-gram and no partner.  A text of fewer than n words has one
n-gram, the run of all its words.  Rows with a null id are left out, as they couldn't be named.  Rows repeated under one id
are one document, rows of different texts under one id too: its links and copies are those of all its sets (also of two that
are near copies of one another).  An empty table gives no rows.  Other columns are never read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import common, groups, kernel

N, THRESHOLD, TILE = 3, 0.5, 256
#: A token is hot if it is this share of all tokens' occurrences and HOT_LEAST times there; so is a text by HOT_TEXTS.
SHARE, HOT_LEAST, HOT_TEXTS = 2.0**-18, 1 << 14, 2.0**-12
#: Up to so many dropped documents' ids are broadcast.
BROADCAST_DROPPED = 200_000
#: Bytes of text whose n-grams are packed together.
PACK = 1 << 23
#: Bytes of a token within its bucket, of one in a set, and of a fingerprint.
WIDE, HELD, PRINT = 5, 6, 3
_ORDERS = tuple(np.uint64(k * 0xA24BAED4963EE407 & (1 << 64) - 1) for k in (1, 2))
#: The place of hot tokens in order A: behind all counted ones.
_LAST = 1 << 32


def _u64(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint64)


def _packed(x: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unpacked(x: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(x) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(x, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel().astype(np.uint64)


def _pack32(x: np.ndarray) -> bytes:
    """Small numbers in planes, the upper ones of which compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack32(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def required(size: np.ndarray | int, t: float) -> np.ndarray:
    """The least overlap with any set, for a set of this size: ceil(t * size), safe from rounding."""
    return np.ceil(np.asarray(size) * t - 1e-9).astype(np.int64)


class Buckets:
    """Token buckets: even ranges of hashes; within its bucket a token is known by 40 bits."""

    def __init__(self, n: int) -> None:
        self.last, self.width = n - 1, min((1 << 64) // n + 1, (1 << 64) - 1)
        self.shift = np.uint64(max(0, self.width.bit_length() - 8 * WIDE))

    def split(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = np.minimum(tokens // np.uint64(self.width), np.uint64(self.last)).astype(np.int32)
        return part, (tokens - part.astype(np.uint64) * np.uint64(self.width)) >> self.shift

    def joined(self, part: int, rest: np.ndarray) -> np.ndarray:
        return np.uint64(part) * np.uint64(self.width) + (rest << self.shift)


def _shredded(rows: int, part: np.ndarray, parts: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' values for each part that has some; equal parts stay in order."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        here = order[bounds[p] : bounds[p + 1]]
        yield int(p), [c[here] for c in columns]


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _first_of(names: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct (name, tail) is first, in their order, and the place of each entry among these."""
    order = np.lexsort((np.arange(len(names)), tails, names))
    n, t = names[order], tails[order]
    new = np.ones(len(order), bool)
    new[1:] = (n[1:] != n[:-1]) | (t[1:] != t[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _packs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pack of documents (doc_id, text): ids, sizes of their sets (0: no word), and of those that have one the tokens set by
    set, names and tails."""
    sets: list[np.ndarray] = []
    ids: list[int] = []
    held = 0

    def packed() -> tuple:
        size = np.array([len(s) for s in sets], np.int64)
        some = [s for s in sets if len(s)]
        tokens = np.concatenate(some) if some else np.zeros(0, np.uint64)
        begin = (np.cumsum(size) - size)[size > 0]
        count = size[size > 0].astype(np.uint64)
        names, tails = ((kernel.mix(np.add.reduceat(kernel.mix(tokens ^ x), begin) + count) if len(begin) else np.zeros(0, np.uint64)) for x in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)))
        return np.array(ids, np.int64), size, tokens, names, tails >> np.uint64(32)

    for part in (s for b in batches for s in kernel.slices(b, "text")):
        data, offsets = kernel.buffers(part.column(1))
        grams, start = kernel.shingles(*kernel.words(data, offsets)[:2], n)
        sets += [np.unique(grams[start[i] : start[i + 1]]) for i in range(part.num_rows)]
        ids += part.column(0).to_pylist()
        held += len(data)
        if held >= PACK:
            yield packed()
            sets, ids, held = [], [], 0
    if ids:
        yield packed()


FIRST = pa.schema([("kind", pa.int32()), ("name", pa.int64()), ("tail", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64())])
DOC, TOKEN, TOTAL = 0, 1, 2


def first_scan(n: int):
    """Names and sizes of all documents' sets; tokens that a pack has three times at least and is not too poor in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, size, tokens, names, tails in _packs(batches, n):
            none = np.zeros(len(ids), np.int64)
            name, tail = none.copy(), none.copy()
            name[size > 0], tail[size > 0] = names.view(np.int64), tails.view(np.int64)
            often, count = np.unique(tokens, return_counts=True)
            hot = count >= max(3, len(tokens) * SHARE / 2)
            often, count = often[hot].view(np.int64), count[hot]
            zero = np.zeros(len(often) + 1, np.int64)
            columns = [
                np.concatenate([np.full(len(ids), DOC), np.full(len(often), TOKEN), [TOTAL]]), np.concatenate([name, often, [0]]), np.concatenate([tail, zero]),
                np.concatenate([size, count, [len(tokens)]]), np.concatenate([ids, zero]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, FIRST, strict=True)], schema=FIRST)

    return run


class Hot:
    """Tokens that are too frequent to be gathered, in the order of their hashes, with their places in order A; and the texts with
    many copies, with the document that stands for each."""

    def __init__(self, tokens: list[tuple[int, int]], texts: list[tuple[int, int, int]]) -> None:
        rows = sorted((t & (1 << 64) - 1, n) for t, n in tokens)
        self.tokens = np.array([t for t, _ in rows], np.uint64)
        self.place = np.empty(len(rows), np.int64)
        self.place[np.lexsort((self.tokens, np.array([n for _, n in rows], np.int64)))] = _LAST + np.arange(len(rows))
        self.texts = {(name, tail): doc for name, tail, doc in texts}

    def at(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are hot, and where each (of those) is in the list."""
        if not len(self.tokens):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return self.tokens[at] == tokens, at


def hottest(first: DataFrame, share: float = SHARE, least: int = HOT_LEAST) -> Hot:
    """At most 2 / ``share`` tokens, among them all that are ``share`` of all occurrences; at most 1 / HOT_TEXTS texts."""
    counts = first.where(F.col("kind") != TOKEN).agg(F.sum(F.when(F.col("kind") == TOTAL, F.col("n"))).alias("t"), F.count_if(F.col("kind") == DOC).alias("d")).first()
    total = counts["t"] or 0
    tokens = first.where(F.col("kind") == TOKEN).groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, total * share / 2))
    texts = first.where((F.col("kind") == DOC) & (F.col("n") > 0)).groupBy("name", "tail").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id")).where(F.col("k") >= max(least, counts["d"] * HOT_TEXTS))
    return Hot([(r["name"], r["n"]) for r in tokens.collect()], [(r["name"], r["tail"], r["doc_id"]) for r in texts.collect()])


SCAN = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("of", pa.int32())] + [(c, pa.binary()) for c in ("tokens", "frequency", "counts", "names", "tails", "sizes")])
TOKENS, HOME, SETS = 0, 1, 2


def second_scan(n: int, buckets: int, sent):
    """By token bucket the tokens set by set, with the names of the sets (kind TOKENS); by bucket of sets their names, sizes and
    hot tokens (kind HOME)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, to = sent.value, Buckets(buckets)
        for ids, size, tokens, names, tails in _packs(batches, n):
            ids, size = ids[size > 0], size[size > 0]
            if not len(ids):
                continue
            stays = np.ones(len(ids), bool)
            if hot.texts:
                stays = np.array([hot.texts.get(k, i) == i for k, i in zip(zip(names.view(np.int64).tolist(), tails.view(np.int64).tolist(), strict=True), ids.tolist(), strict=True)])
            owner = np.repeat(np.arange(len(ids)), size)
            tokens, owner = tokens[stays[owner]], owner[stays[owner]]
            is_hot, at = hot.at(tokens)
            out = []
            many = np.bincount(owner[is_hot], minlength=len(ids))
            begin, hots = np.cumsum(many) - many, at[is_hot]
            here = np.flatnonzero(stays)
            for p, (own,) in _shredded(len(here), (names[here] % np.uint64(buckets)).astype(np.int32), buckets, [here]):
                k = np.arange(int(many[own].sum())) + np.repeat(begin[own] - (np.cumsum(many[own]) - many[own]), many[own])
                out.append((HOME, p, -1, _pack32(hots[k]), b"", _pack32(many[own]), names[own].tobytes(), _packed(tails[own], 4), _pack32(size[own])))
            part, rest = to.split(tokens[~is_hot])
            for p, (tok, own) in _shredded(len(rest), part, buckets, [rest, owner[~is_hot]]):
                there, many_ = np.unique(own, return_counts=True)
                out.append((TOKENS, p, p, _packed(tok, WIDE), b"", _pack32(many_), names[there].tobytes(), _packed(tails[there], 4), b""))
            if out:
                yield _batch(out, SCAN)

    return run


def by_bucket(batches: Iterator[pa.RecordBatch], column: str = "bucket") -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket of a partition sorted by it."""
    rows = (r for b in batches for r in b.to_pylist())
    for bucket, group in itertools.groupby(rows, key=lambda r: r[column]):
        yield bucket, list(group)


def _stacked(group: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many tokens each entry of all rows has; the owners of all tokens as places in the joined lists of entries; names and
    tails."""
    counts = np.concatenate([_unpack32(r["counts"]) for r in group])
    return counts, np.repeat(np.arange(len(counts)), counts), np.concatenate([_u64(r["names"]) for r in group]), np.concatenate([_unpacked(r["tails"], 4) for r in group])


def frequencies(parts: int):
    """By token bucket: shared tokens, with their frequencies, by the bucket of their set (kind SETS).  Other rows pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in by_bucket(batches):
            homes = [tuple(r.values()) for r in group if r["kind"] == HOME]
            if homes:
                yield _batch(homes, SCAN)
            group = [r for r in group if r["kind"] == TOKENS]
            if not group:
                continue
            _, owner, names, tails = _stacked(group)
            tokens = np.concatenate([_unpacked(r["tokens"], WIDE) for r in group])
            del group
            kept = np.zeros(len(names), bool)
            kept[_first_of(names, tails)[0]] = True  # documents of one set count once
            tokens, owner = tokens[kept[owner]], owner[kept[owner]]
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            count = np.diff(np.append(begin, len(tokens)))
            df = np.repeat(count, count)
            shared = df > 1
            tokens, owner, df = tokens[shared], owner[shared], df[shared]
            order = np.argsort(owner, kind="stable")
            tokens, owner, df = tokens[order], owner[order], df[order]
            out = []
            for p, (tok, own, f) in _shredded(len(tokens), (names[owner] % np.uint64(parts)).astype(np.int32), parts, [tokens, owner, df]):
                there, many = np.unique(own, return_counts=True)
                out.append((SETS, p, bucket, _packed(tok, WIDE), _pack32(f), _pack32(many), names[there].tobytes(), _packed(tails[there], 4), b""))
            if out:
                yield _batch(out, SCAN)

    return run


SET = pa.schema([("key", pa.int64()), ("name", pa.int64()), ("tail", pa.int64()), ("size", pa.int32()), ("short", pa.int32()), ("cold", pa.int32()), ("tokens", pa.binary()), ("prefixes", pa.binary())])


def prefixes(t: float, parts: int, sent):
    """By bucket of sets: those that can have a partner, with all shared tokens in order A (HELD bytes each), how many of them a
    prefix has, how many of these aren't hot, and fingerprints of the prefixes under A, B and C."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, to = sent.value, Buckets(parts)
        for _, group in by_bucket(batches):
            home, rest = [r for r in group if r["kind"] == HOME], [r for r in group if r["kind"] == SETS]
            del group
            many, owner, names, tails = _stacked(home)
            homes = len(names)
            hots = np.concatenate([_unpack32(r["tokens"]) for r in home])
            sizes = np.concatenate([_unpack32(r["sizes"]) for r in home])
            tokens, df = hot.tokens[hots] if len(hots) else np.zeros(0, np.uint64), hot.place[hots] if len(hots) else np.zeros(0, np.int64)
            if rest:
                _, more, n2, t2 = _stacked(rest)
                names, tails = np.concatenate([names, n2]), np.concatenate([tails, t2])
                first, place = _first_of(names, tails)
                counted = np.concatenate([to.joined(r["of"], _unpacked(r["tokens"], WIDE)) for r in rest])
                once = np.zeros(len(names), bool)
                once[first] = True  # of documents of one set the first one's hot tokens count
                here = once[owner]
                owner = np.concatenate([place[owner[here]], place[more + homes]])
                tokens, df = np.concatenate([tokens[here], counted]), np.concatenate([df[here], *[_unpack32(r["frequency"]) for r in rest]])
            else:
                first, place = _first_of(names, tails)
                once = np.zeros(len(names), bool)
                once[first] = True
                tokens, df, owner = tokens[once[owner]], df[once[owner]], place[owner[once[owner]]]
            del home, rest
            size = np.zeros(len(first), np.int64)
            size[place[:homes]] = sizes
            names, tails = names[first], tails[first]
            # Two sets of one name differ in their tails; all but the first get another key.
            key = names.copy()
            again = np.concatenate([[False], names[1:] == names[:-1]])
            key[again] = kernel.mix(names[again] ^ tails[again])
            short = np.bincount(owner, minlength=len(first)) - required(size, t) + 1  # the prefix without the tokens of one set only
            live = short > 0
            tokens, df, owner = tokens[live[owner]], df[live[owner]], owner[live[owner]]
            order = np.lexsort((tokens, df, owner))
            tokens, df, owner = kernel.mix(tokens[order]) >> np.uint64(64 - 8 * HELD), df[order], owner[order]
            begin = np.searchsorted(owner, np.arange(len(first) + 1))
            cut = np.arange(len(owner)) - begin[owner] < short[owner]
            cold = np.bincount(owner[cut & (df < _LAST)], minlength=len(first))
            views = [_packed(tokens[cut], PRINT)]
            for k in _ORDERS:
                views.append(_packed(tokens[np.lexsort((kernel.mix(tokens ^ k), owner))][cut], PRINT))
            whole = _packed(tokens, HELD)
            alive = np.flatnonzero(live)
            at = np.cumsum(short[alive]) - short[alive]
            for low in range(0, len(alive), 2000):
                some = alive[low : low + 2000]
                held = [whole[HELD * a : HELD * b] for a, b in zip(begin[some].tolist(), begin[some + 1].tolist(), strict=True)]
                blobs = [b"".join(v[PRINT * a : PRINT * (a + s)] for v in views) for a, s in zip(at[low : low + 2000].tolist(), short[some].tolist(), strict=True)]
                columns = [key[some].view(np.int64), names[some].view(np.int64), tails[some].view(np.int64), size[some], short[some], cold[some], held, blobs]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, SET, strict=True)], schema=SET)

    return run


def _schema(s: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>", pa.float64(): "double"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in s)


def _meets(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left has in common with each on the right."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    if not len(both):
        return np.zeros((len(left), len(right)), np.int64)
    total = np.zeros((len(left), len(right)), np.float32)

    def places(x: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, x), len(both) - 1)
        ok = both[at] == x
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], at[ok]

    (ra, ca), (rb, cb) = places(a, left), places(b, right)
    step = 1 << 13  # columns at once, so that memory is bounded
    for low in range(0, len(both), step):
        m, n = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        x, y = (ca >= low) & (ca < low + step), (cb >= low) & (cb < low + step)
        m[ra[x], ca[x] - low] = 1
        n[rb[y], cb[y] - low] = 1
        total += m @ n.T
    return total.astype(np.int64)


POSTED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
MET = pa.schema([("key", pa.int64()), ("pivot", pa.int64())])


def posted(parts: int):
    """By bucket of tokens, the prefix tokens (not the hot ones) of some thousand sets (key, cold, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(low, 4000) for low in range(0, b.num_rows, 4000)):
                keys, cold = (np.asarray(part.column(i)).astype(np.int64) for i in (0, 1))
                tokens = _unpacked(b"".join(t[: HELD * c] for t, c in zip(part.column(2).to_pylist(), cold.tolist(), strict=True)), HELD)
                if not len(tokens):
                    continue
                out = []
                for p, (tok, own) in _shredded(len(tokens), (kernel.mix(tokens) % np.uint64(parts)).astype(np.int32), parts, [tokens, np.repeat(np.arange(len(keys)), cold)]):
                    there, many = np.unique(own, return_counts=True)
                    out.append((p, keys[there].tobytes(), _pack32(many), _packed(tok, HELD)))
                yield _batch(out, POSTED)

    return run


def pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By bucket of tokens: each set with the least sets of the tokens that it isn't alone with."""
    for _, group in by_bucket(batches):
        keys = np.concatenate([np.repeat(np.frombuffer(r["keys"], np.int64), _unpack32(r["counts"])) for r in group])
        tokens = np.concatenate([_unpacked(r["tokens"], HELD) for r in group])
        order = np.lexsort((keys, tokens))
        keys, tokens = keys[order], tokens[order]
        begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.append(begin, len(tokens)))
        both = np.stack([keys, np.repeat(keys[begin], count)], axis=1)[np.repeat(count, count) > 1]
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]).any(1)
        yield pa.RecordBatch.from_arrays([pa.array(both[new, 0]), pa.array(both[new, 1])], schema=MET)


def _hot_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, token) of the hot tokens in prefixes (key, cold, tokens, short)."""
    for b in batches:
        for key, cold, tokens, short in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if short > cold:
                got = _unpacked(tokens[HELD * cold : HELD * short], HELD).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), key)), pa.array(got)], names=["key", "token"])


UNIT = ("pivot", "ta", "tb")


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict], list[dict], bool]]:
    """The sets of each unit: (unit, left, right, whether these are the same)."""
    rows = (r for b in batches for r in b.to_pylist())
    for unit, group in itertools.groupby(rows, key=lambda r: tuple(r[c] for c in UNIT)):
        sides: tuple[list, list] = ([], [])
        for r in group:
            sides[r["side"]].append(r)
        same = unit[1] == unit[2]
        yield unit, sides[0], sides[0] if same else sides[1], same


MASK = pa.schema([("pivot", pa.int64()), ("ta", pa.int32()), ("tb", pa.int32()), ("side", pa.int32()), ("key", pa.int64()), ("mask", pa.binary())])


def candidates(t: float):
    """Of a unit, the sets that are in a pair that passes the filters of all orders, the length bound, and has its least common
    pivot here; those on the left with a bit for each on the right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for unit, left, right, same in by_unit(batches):
            if not left or not right:
                continue
            size = [np.array([r["size"] for r in rows], np.int64) for rows in (left, right)]
            ok = np.minimum(size[0][:, None], size[1][None]) >= required(np.maximum(size[0][:, None], size[1][None]), t)
            if same:
                ok = np.triu(ok, 1)
            earlier = [[np.array([p for p in r["pivots"] if p < unit[0]], np.int64).view(np.uint64) for r in rows] for rows in (left, right)]
            if any(map(len, earlier[0])) and any(map(len, earlier[1])):
                ok &= _meets(*earlier) == 0
            views = [[_unpacked(r["prefixes"], PRINT).reshape(3, -1) for r in rows] for rows in (left, right)]
            for order in range(3):
                if ok.any():
                    ok &= _meets(*([np.unique(v[order]) for v in vs] for vs in views)) > 0
            i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            if same:
                i = j = np.union1d(i, j)
            bits = np.packbits(ok[np.ix_(i, j)], axis=1)
            out += [(*unit, 0, left[k]["key"], bits[n].tobytes()) for n, k in enumerate(i)]
            if not same:
                out += [(*unit, 1, right[k]["key"], None) for k in j]
            if len(out) > 20_000:
                yield _batch(out, MASK)
                out = []
        if out:
            yield _batch(out, MASK)

    return run


def matches(t: float, left: list[dict], right: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs among a unit's candidates that are verified, and their Jaccard."""
    i, j = np.nonzero(np.stack([np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=len(right)) for r in left]))
    tokens = [[_unpacked(r["tokens"], HELD) for r in rows] for rows in (left, right)]
    if len(i) > len(left) + len(right):
        met = _meets(*tokens)[i, j]
    else:  # few pairs
        met = np.array([len(np.intersect1d(tokens[0][a], tokens[1][b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    size = [np.array([r["size"] for r in rows], np.int64) for rows in (left, right)]
    union = size[0][i] + size[1][j] - met
    good = met >= t * union - 1e-9
    return i[good], j[good], met[good] / union[good]


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])
LINKS = pa.schema([("key", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def verify(t: float, pairs: bool):
    """The pairs of each unit; or how many each set is in, and the least set of the unit that they link it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = PAIR if pairs else LINKS
        out: list[tuple] = []
        for _, left, right, same in by_unit(batches):
            i, j, ratio = matches(t, left, right)
            if pairs:
                out += [(left[a]["key"], right[b]["key"], float(r)) for a, b, r in zip(i, j, ratio, strict=True)]
            else:
                keys = np.array([r["key"] for r in left] + ([] if same else [r["key"] for r in right]), np.int64)
                j = j if same else j + len(left)
                count, root = np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys)), _forest(len(keys), i, j)
                out += [(int(keys[k]), int(count[k]), int(keys[root[k]])) for k in np.flatnonzero(count)]
            if len(out) > 20_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return run


def _sets(docs: DataFrame, n: int, threshold: float, share: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, name, tail, size) of every document that has an id, size 0 where there is no word; and the sets (SET) that can
    have a partner."""
    spark = docs.sparkSession
    parts = common.partitions(spark)
    texts = common.own(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), common.lowered(F.col("text")).alias("text"))
    first = common.cut(texts.transform(kernel.arrow, first_scan(n), _schema(FIRST)))
    sent = spark.sparkContext.broadcast(hottest(first, share, least))
    tokens = common.placed(texts.transform(kernel.arrow, second_scan(n, parts, sent), _schema(SCAN)), "bucket", parts).sortWithinPartitions("bucket")
    shared = common.placed(tokens.transform(kernel.arrow, frequencies(parts), _schema(SCAN)), "bucket", parts).sortWithinPartitions("bucket")
    sets = common.cut(shared.transform(kernel.arrow, prefixes(threshold, parts, sent), _schema(SET)))
    return first.where(F.col("kind") == DOC).select("doc_id", "name", "tail", F.col("n").alias("size")), sets


def _verified(sets: DataFrame, threshold: float, tile: int, pairs: bool) -> DataFrame:
    """PAIR or LINKS of the sets."""
    parts = common.partitions(sets.sparkSession)
    packed = common.placed(sets.select("key", "cold", "tokens").transform(kernel.arrow, posted(parts), _schema(POSTED)), "bucket", parts).sortWithinPartitions("bucket")
    # The sets of a hot token are never together in one task: its least set is found by an aggregation, and joined back.
    hot = sets.where("short > cold").select("key", "cold", "tokens", "short").transform(kernel.arrow, _hot_tokens, "key bigint, token bigint")
    least = hot.groupBy("token").agg(F.min("key").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("token", "pivot")
    both = packed.transform(kernel.arrow, pivots, _schema(MET)).unionByName(hot.join(least, "token").select("key", "pivot"))
    met = both.groupBy("key").agg(F.array_sort(F.collect_set("pivot")).alias("pivots"))
    each = common.cut(met.select("key", "pivots", F.explode("pivots").alias("pivot")))
    # A pivot under which all sets have the same earlier one has no pair of its own.
    sizes = each.groupBy("pivot").agg(F.count("*").alias("n"), F.min(F.col("pivots")[0]).alias("lo"), F.max(F.col("pivots")[0]).alias("hi")).where("n > 1 and (lo < hi or lo = pivot)")
    placed = each.join(sizes.select("pivot", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "pivot").withColumn("tile", F.pmod(F.xxhash64("key"), "tiles").cast("int"))
    units = placed.select("key", "pivots", "pivot", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        "key", "pivots", "pivot", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), (F.col("tile") > F.col("other")).cast("int").alias("side")
    )

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, *UNIT).sortWithinPartitions(*UNIT, "side", "key")

    short = together(units.join(sets.select("key", "size", "prefixes"), "key").select(*UNIT, "side", "key", "size", "prefixes", "pivots"))
    masks = short.transform(kernel.arrow, candidates(threshold), _schema(MASK))
    whole = together(masks.join(sets.select("key", "size", "tokens"), "key").select(*UNIT, "side", "key", "mask", "size", "tokens"))
    return whole.transform(kernel.arrow, verify(threshold, pairs), _schema(PAIR if pairs else LINKS))


def _stands(listed: DataFrame) -> DataFrame:
    """(name, tail, doc, copies): the least document of each set, and how many documents have it."""
    return listed.where("size > 0").select("doc_id", "name", "tail").distinct().groupBy("name", "tail").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"))


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tile: int = TILE, share: float = SHARE, least: int = HOT_LEAST) -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs of different sets that reach the threshold, each as its least document."""
    listed, sets = _sets(docs, n, threshold, share, least)
    doc = sets.select("key", "name", "tail").join(_stands(listed), ["name", "tail"]).select("key", "doc")
    p = _verified(sets, threshold, tile, True)
    for side in ("a", "b"):
        p = p.join(doc.select(F.col("key").alias(side), F.col("doc").alias(f"doc_{side}")), side)
    return p.where("doc_a <> doc_b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tile: int = TILE, share: float = SHARE, least: int = HOT_LEAST) -> DataFrame:
    """(doc_id, class_id, links, copies) of every document that has an id."""
    listed, sets = _sets(docs, n, threshold, share, least)
    stands = common.cut(_stands(listed))
    found = common.cut(_verified(sets, threshold, tile, False))
    doc = sets.select("key", "name", "tail").join(stands, ["name", "tail"]).select("key", "doc")
    a, b = doc.select("key", F.col("doc").alias("a")), doc.select(F.col("key").alias("root"), F.col("doc").alias("b"))
    spanned = found.where("key <> root").select("key", "root").distinct().join(a, "key").join(b, "root").select("a", "b")
    # Documents of one set take the class of its least document; only those of several sets link these.
    distinct = listed.where("size > 0").select("doc_id", "name", "tail").distinct()
    several = distinct.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    bridges = distinct.join(several, "doc_id").join(stands, ["name", "tail"]).select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    parts = groups.components(spanned.unionByName(bridges)).select(F.col("a").alias("doc"), F.col("b").alias("class"))
    links = found.groupBy("key").agg(F.sum("links").alias("links")).join(sets.select("key", "name", "tail"), "key").select("name", "tail", "links")
    of = stands.join(parts, "doc", "left").join(links, ["name", "tail"], "left").select("name", "tail", F.coalesce("class", "doc").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), (F.col("copies") - 1).alias("copies"))
    rows = distinct.join(of, ["name", "tail"]).select("doc_id", "class", "links", "copies").unionByName(listed.where("size = 0").select("doc_id", F.lit(None).cast("bigint").alias("class"), F.lit(0).cast("bigint").alias("links"), F.lit(0).cast("bigint").alias("copies")))
    return rows.groupBy("doc_id").agg(F.coalesce(F.min("class"), F.col("doc_id")).alias("class_id"), F.sum("links").alias("links"), F.sum("copies").alias("copies"))


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """The documents without those that are linked, directly or through others, with one of a lesser id; all columns as they
    were.  Rows of one id stay or go together; rows with a null id stay."""
    gone = common.cut(classes(docs, n, threshold, tile).where("class_id <> doc_id").select(F.col("doc_id").alias("__gone")))
    small = gone.count() <= BROADCAST_DROPPED
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"].cast("bigint") == gone["__gone"], "left_anti")
