from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
import regex

from sheaf.llm import bpe, kernel

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def ranks():
    return bpe.load()


@pytest.fixture(scope="module")
def official(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_splitting_and_encoding_are_the_tokenizers_own(ranks, official):
    rng = random.Random(4)
    parts = ["a", "b", "'s", "'ll", "'", "s", " ", "  ", "\n", " ", "é", "日本", "1", "23", "!", "'re", "　", "the", "ing", " '", "'S", "\t", "\r\n", "😀", "ß", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    data, offsets = kernel.buffers(pa.array(texts))
    tool = bpe.Batches(ranks)
    begin, first = bpe.split(data, offsets)
    ends = [*begin[1:].tolist(), len(data)]
    whole = data.tobytes()
    for i, t in enumerate(texts):
        assert [whole[begin[j] : ends[j]].decode() for j in range(first[i], first[i + 1])] == regex.findall(PATTERN, t)
    tokens, at = tool.encode(data, offsets)
    assert all(tokens[at[i] : at[i + 1]].tolist() == official.encode_ordinary(t) for i, t in enumerate(texts))
    assert tool.decode(tokens).tobytes() == whole


def test_words_against_plain_merging(ranks):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("aeinorst ") for _ in range(rng.randint(1, 14))).encode() for _ in range(1500)})
    e = bpe.Encoder(ranks)
    assert [[e.bytes[t] for t in np.frombuffer(ts, np.int32).tolist()] for ts in e.encode(words)] == [e.merged(w) for w in words]
    assert e.nodes < sum(map(len, words))  # prefixes are shared


def test_caches_change_no_result(ranks, official, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    tool = bpe.Batches(ranks)
    for t in ("these words and those words", "words again, others and these", "the end of these others"):
        data, offsets = kernel.buffers(pa.array([t]))
        assert tool.encode(data, offsets)[0].tolist() == official.encode_ordinary(t)


def test_hard_cases(hard, hard_rows, official):
    got = {(r["doc_id"], tuple(r["tokens"]) if r["tokens"] is not None else None, r["n_tokens"], r["exact"]) for r in bpe.encode(hard).collect()}
    want = set()
    for i, t in hard_rows:
        tokens = None if t is None else tuple(official.encode_ordinary(t))
        want.add((i, tokens, None if t is None else len(tokens), None if t is None else True))
    assert got == want
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(bpe.encode(hard)).collect()}
    assert back == set(hard_rows)


def test_empty(empty):
    assert bpe.encode(empty).count() == 0


def test_bytes_that_are_no_text(spark, ranks):
    d = spark.sql("select cast(7 as bigint) as doc_id, cast(unhex('61ff62e282') as string) as text")
    r = bpe.encode(d).first()
    e = bpe.Encoder(ranks)
    assert r["exact"] and b"".join(e.bytes[t] for t in r["tokens"]) == bytes.fromhex("61ff62e282")


@pytest.mark.parametrize("unit", ["ab", "x", "antidisestablishment", "qzjxv", "é"])
def test_time_is_linear_in_a_word(unit):
    e = bpe.Encoder(bpe.load())
    took = []
    for size in (50_000, 400_000):
        word = (unit * size)[:size].encode()
        began = time.process_time()
        (got,) = e.encode([word])
        took.append(time.process_time() - began)
        assert b"".join(e.bytes[t] for t in np.frombuffer(got, np.int32).tolist()) == word
    assert took[1] < 30


def test_suffixes_against_brute_force():
    e = bpe.Encoder(bpe.load())
    for begin in sorted(e.begins)[::997]:
        assert list(e.suffixes(begin)) == [(e.ranks[begin[i:]], len(begin) - i) for i in range(len(begin)) if begin[i:] in e.ranks and (len(begin) - i == 1 or e.parts(e.ranks[begin[i:]]) is not None)]


def test_words_are_known_in_two_generations(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    tool, plain = bpe.Batches(bpe.load()), bpe.Encoder(bpe.load())
    rng = random.Random(3)
    for _ in range(30):
        words = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 90]))).encode() for _ in range(40)]
        assert tool.words(words) == [plain.encode([w])[0] for w in words]
        assert all(len(w) <= bpe.KEPT_BYTES for w in tool.known)
