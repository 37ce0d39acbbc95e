"""BPE encoding and decoding by a depth-first walk over a trie of distinct words.

Texts are split into words by the tokenizer's pattern; a word is encoded once in a batch, and its tokens are kept by the
worker.  New words are sorted, which lays them out as a trie in depth-first order: a word adds the nodes behind what it has in
common with the word before.  The state of a node is the last token of the encoding of the path to it.  A node's last token is
the suffix token of its path that is compatible with the last token of the rest of the path; two tokens are compatible if
byte-pair merging of their joint bytes gives these two again.  Suffix tokens come from an automaton: a node keeps how long the
longest suffix of its path is that some token begins with, which grows by one byte at most from node to node, so that a walk
takes time linear in the word, however long.  So a prefix that words share is encoded once, and a word's
tokens are read off backwards from its node.

Splitting is exact for the pattern that the given vocabularies use (contractions; letters, numbers or other characters with at
most one space before; white space), done on whole batches of UTF-8 bytes.  Equal words are found by 64-bit hashes and checked
by 64 further bits; words that fail the check are encoded one by one.

Everything is a scan: no shuffle, and what is sent to executors is the vocabulary, of a fixed size.

Cases: a null text gives null tokens; an empty text no tokens.  Bytes that aren't UTF-8 count as characters that are neither
letters, numbers nor white space.  Repeated rows are encoded each; an empty table gives no rows.  Other columns are never read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import common, kernel

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A worker keeps the tokens of so many words; beyond, those of words that it then doesn't meet for as long are dropped.
KEPT_WORDS = 3 << 15
#: Longer words (bytes) are encoded each time, so that the memory of what is kept is bounded.
KEPT_BYTES = 64
#: A worker keeps so many answers about pairs of tokens.
KEPT_PAIRS = 1 << 18
#: Bytes of text split at once.
SLICE = 1 << 19
OTHER, LETTER, NUMBER, SPACE = range(4)
_CONTRACTIONS = [s.encode() for s in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")]
_NEVER = 1 << 40


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of lines with base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


class Encoder:
    """Encodes words (bytes) with the ranks of a vocabulary that has all single bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.begins = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        self._suffixes: dict[bytes, tuple[tuple[int, int], ...]] = {}
        self._pairs: dict[int, tuple[int, int]] = {}  # shared, as a token ends many strings
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._ends: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.nodes = 0

    def merged(self, word: bytes, below: int = _NEVER) -> list[bytes]:
        """Plain byte-pair merging with ranks under ``below``."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; None for a byte, and for a token that merging never gives."""
        if token not in self._parts:
            word = self.bytes[token]
            got = self.merged(word, token) if len(word) > 1 else []
            self._parts[token] = (self.ranks[got[0]], self.ranks[got[1]]) if len(got) == 2 else None
        return self._parts[token]

    def _edge(self, token: int, right: int) -> list[tuple[bytes, int]]:
        """The pieces at the left or right end of a token while it is merged, and the rank of the merge that ends each."""
        kept = self._ends[right]
        if token not in kept:
            pieces, until, t = [], _NEVER, token
            while True:
                pieces.append((self.bytes[t], until))
                both = self.parts(t)
                if both is None:
                    break
                until, t = t, both[right]
            kept[token] = pieces
        return kept[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together are merged into these two tokens: no merge across is ever the next one."""
        key = left << 32 | right
        got = self._fits.get(key)
        if got is None:
            got = True
            for a, end_a in self._edge(left, 1):
                for b, end_b in self._edge(right, 0):
                    rank = self.ranks.get(a + b)
                    if rank is not None and rank < end_a and rank <= end_b:
                        got = False
                        break
                if not got:
                    break
            if len(self._fits) >= KEPT_PAIRS:
                self._fits.clear()
            self._fits[key] = got
        return got

    def suffixes(self, begin: bytes) -> tuple[tuple[int, int], ...]:
        """Tokens that end a string with which some token begins, and their lengths, the longest first; none that merging never
        gives."""
        got = self._suffixes.get(begin)
        if got is None:
            found = []
            for at in range(len(begin)):
                token = self.ranks.get(begin[at:])
                if token is not None and (len(begin) - at == 1 or self.parts(token) is not None):
                    found.append(self._pairs.setdefault(token, (token, len(begin) - at)))
            got = tuple(found)
            if len(self._suffixes) >= KEPT_PAIRS:
                self._suffixes.clear()
            self._suffixes[begin] = got
        return got

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Tokens of each word, as 32-bit numbers; the words are distinct and sorted."""
        begins, suffixes, fits, known = self.begins, self.suffixes, self.fits, self._fits
        last, size, reach = array("i"), array("i"), array("i")  # of each node on the path: last token, its length, longest begin
        out, before = [], b""
        for word in words:
            shared = 0
            for x, y in zip(before, word):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del last[shared:], size[shared:], reach[shared:]
            long = reach[-1] if shared else 0
            for end in range(shared + 1, len(word) + 1):
                begin = word[end - long - 1 : end]
                while begin not in begins:
                    begin = begin[1:]
                long = len(begin)
                for token, length in suffixes(begin):
                    if length < end:
                        left = last[end - length - 1]
                        ok = known.get(left << 32 | token)
                        if ok is None:
                            ok = fits(left, token)
                        if not ok:
                            continue
                    last.append(token)
                    size.append(length)
                    reach.append(long)
                    break
            self.nodes += len(word) - shared
            tokens, at = array("i"), len(word)
            while at:
                tokens.append(last[at - 1])
                at -= size[at - 1]
            tokens.reverse()
            out.append(tokens.tobytes())
            before = word
        return out


def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for c, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            low, high = ord(m[0][0]), ord(m[0][-1])
            table[low : high + 1] = c
    table[0xD800:0xE000] = OTHER
    return table


_table: list[np.ndarray] = []


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte's character, and whether a character begins at the byte."""
    if not _table:
        _table.append(_classes())
    table = _table[0]
    if not (data >= 128).any():
        return table[data], np.ones(len(data), bool)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    size[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
    lead = np.zeros(len(data), bool)
    lead[np.cumsum(size) - size] = True
    return np.repeat(table[points], size), lead


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts begin (ending where the next one begins), and the first word of each text."""
    size = len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind, lead = classes(data)
    border = np.zeros(size + 1, bool)
    border[offsets] = True
    change = border[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    change[0] = True
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], size)
    blank = kind[begin] == SPACE
    closed = border[end]  # nothing of this text follows
    # White space before other characters leaves its last character, which if a space belongs to what follows.
    inner = np.flatnonzero(blank & ~closed)
    last = np.maximum.accumulate(np.where(lead, np.arange(size), 0))[end[inner] - 1]
    starts = change.copy()
    starts[last] = True
    joins = data[last] == 32
    starts[end[inner][joins]] = False
    # A contraction begins at an apostrophe that no space belongs to.
    quote = begin[(kind[begin] == OTHER) & (data[begin] == 39) & (end - begin == 1) & ~closed]
    quote = quote[starts[quote]]
    for c in _CONTRACTIONS:
        n = len(c)
        here = quote[quote + n <= size]
        for i in range(1, n):
            here = here[(data[here + i] == c[i]) & ~border[here + i]]
        starts[here + 1] = False
        rest = here[here + n < size] + n
        starts[rest] = True
        quote = np.setdiff1d(quote, here, assume_unique=True)
    words = np.flatnonzero(starts)
    return words, np.searchsorted(words, offsets, "left")


_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each word."""
    forward, back = kernel._powers(len(data) + 1)
    out = []
    for code in _CODES:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(code[data] * forward[: len(data)], out=sums[1:])
        out.append(kernel.mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64)))
    return out


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 .. (size[0] of them), start[1] .. and so on."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)


class Batches:
    """Encodes and decodes texts in bulk, keeping the tokens of words that it has seen."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.encoder = Encoder(ranks)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        ids = max(ranks.values()) + 1
        self.size = np.zeros(ids, np.int64)
        for b, r in ranks.items():
            self.size[r] = len(b)
        self.start = np.cumsum(self.size) - self.size
        self.text = np.frombuffer(b"".join(self.encoder.bytes.get(r, b"") for r in range(ids)), np.uint8)

    def words(self, words: list[bytes]) -> list[bytes]:
        """Tokens of each word, as 32-bit numbers."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set()
        for w in words:
            if w not in known:
                got = older.get(w)
                if got is None:
                    new.add(w)
                else:
                    known[w] = got
        new_ = sorted(new)
        fresh = dict(zip(new_, self.encoder.encode(new_), strict=True))
        known.update((w, t) for w, t in fresh.items() if len(w) <= KEPT_BYTES)
        return [fresh[w] if w in fresh else known[w] for w in words]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, and the first token of each text (one entry more than texts)."""
        begin, first = split(data, offsets)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        end = np.append(begin[1:], len(data))
        one, two = _hashes(data, begin, end)
        _, at, which = np.unique(one, return_index=True, return_inverse=True)
        odd = np.flatnonzero(two[at][which] != two)
        if len(odd):  # words of one hash that differ
            which[odd] = len(at) + np.arange(len(odd))
            at = np.concatenate([at, odd])
        whole = data.tobytes()
        tokens = self.words([whole[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
        size = np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
        pool = np.frombuffer(b"".join(tokens), np.int32)
        counts = size[which]
        out = pool[spread((np.cumsum(size) - size)[which], counts)]
        return out, np.concatenate([[0], np.cumsum(counts)])[first]

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        return self.text[spread(self.start[tokens], self.size[tokens])]


_made: dict[int, Batches] = {}


def _batches(ranks: dict[bytes, int]) -> Batches:
    """One for each vocabulary and worker process, so that words stay known between tasks."""
    key = hash(frozenset(ranks.items()))
    if key not in _made:
        _made.clear()
        _made[key] = Batches(ranks)
    return _made[key]


ENCODED = "doc_id bigint, tokens array<int>, n_tokens int, exact boolean"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("exact", pa.bool_())])


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) of every document; ``exact``: its tokens decode to the text, byte by byte."""
    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _batches(sent.value)
        for b in (s for batch in batches for s in kernel.slices(batch, "text", SLICE)):
            data, offsets = kernel.buffers(b.column(1))
            tokens, first = tool.encode(data, offsets)
            again = tool.decode(tokens)
            ends = np.concatenate([[0], np.cumsum(tool.size[tokens])])[first]
            wrong = np.concatenate([[0], np.cumsum(again != data)]) if len(again) == len(data) else None
            exact = (ends == offsets)[1:] & ((wrong[offsets[1:]] == wrong[offsets[:-1]]) if wrong is not None else False)
            none = b.column(1).is_null()
            mask = np.asarray(none)
            listed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens, pa.int32()), mask=none)
            yield pa.RecordBatch.from_arrays([b.column(0), listed, pa.array(np.diff(first).astype(np.int32), mask=mask), pa.array(exact, mask=mask)], schema=_ENCODED)

    return common.own(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).transform(kernel.arrow, run, ENCODED)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens).  Null tokens give a null text; ids outside of the vocabulary are an error; bytes
    that aren't UTF-8 are replaced."""
    sent = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _batches(sent.value)
        for b in batches:
            texts = [None if t is None else tool.decode(np.asarray(t, np.int64)).tobytes().decode("utf-8", "replace") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return common.own(encoded, "doc_id", "tokens").select(F.col("doc_id").cast("bigint"), F.col("tokens").cast("array<int>")).transform(kernel.arrow, run, "doc_id bigint, text string")
