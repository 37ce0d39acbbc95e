from __future__ import annotations

import random

import numpy as np
import pytest

from sheaf.llm import groups, kernel, ngram_join
from tests.llm import brute


def _random(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") for _ in range(rng.randint(0, 30))] for _ in range(25)]
    docs = []
    for i in range(160):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            if ws:
                ws[rng.randrange(len(ws))] = rng.choice("abcxyz")
        docs.append((i, " ".join(ws)))
    return docs


def _pairs(docs: list[tuple]) -> list[tuple]:
    """A row for each two different sets, as the least documents of either."""
    least: dict = {}
    for i, t in docs:
        if i is not None and brute.words(t):
            s = frozenset(brute.shingles(brute.words(t), 3))
            least[s] = min(i, least.get(s, i))
    rows = [(min(i, j), max(i, j), round(len(a & b) / len(a | b), 9)) for a, i in least.items() for b, j in least.items() if a is not b and i != j and 2 * len(a & b) >= len(a | b)]
    return sorted(set(rows)) if len(rows) == 2 * len(set(rows)) else sorted(r for k, r in enumerate(sorted(rows)) if k % 2)


def _classes(docs: list[tuple]) -> list[tuple]:
    """(doc_id, class_id, links, copies), plainly."""
    sets = {(i, frozenset(brute.shingles(brute.words(t), 3))) for i, t in docs if i is not None and brute.words(t)}
    different = {s for _, s in sets}
    links = {s: sum(s != o and 2 * len(s & o) >= len(s | o) for o in different) for s in different}
    of = brute.components((i, j) for i, s in sets for j, o in sets if 2 * len(s & o) >= len(s | o))
    out = []
    for i in {i for i, _ in docs if i is not None}:
        own = [s for j, s in sets if j == i]
        out.append((i, of.get(i, i), sum(links[s] for s in own), sum(sum(o == s for _, o in sets) - 1 for s in own)))
    return sorted(out)


def _rows(df) -> list[tuple]:
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize(("tile", "hot"), [(2, {}), (256, {}), (4, {"share": 1e-9, "least": 20})])
def test_random_against_brute_force(spark, tile, hot):
    docs = _random(tile)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert _rows(ngram_join.classes(df, tile=tile, **hot)) == _classes(docs)
    assert _rows(ngram_join.pairs(df, tile=tile, **hot)) == _pairs(docs)


def test_hot_tokens_and_texts_are_found(spark):
    docs = [(i, "the same text with many copies") for i in range(30)] + [(100 + i, f"a hot phrase here x{i} y{i} z{i}") for i in range(40)] + [(200 + i, f"u{i} v{i} w{i} a hot phrase here") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    first = df.transform(kernel.arrow, ngram_join.first_scan(3), ngram_join._schema(ngram_join.FIRST))
    hot = ngram_join.hottest(first, least=25)
    assert list(hot.texts.values()) == [0] and len(hot.tokens) == 6  # four of the copies' n-grams, two of the phrase's
    assert (np.sort(hot.place) == np.arange(6) + ngram_join._LAST).all()
    for least in (1, 10, 25, 1000):
        assert _rows(ngram_join.classes(df, least=least)) == _classes(docs)


def test_copies_and_several_texts_under_one_id(spark):
    text = "a b c d e f g h i j k l m n"
    other = "q w r t z u"
    docs = [(5, text), (7, text), (9, text + " o"), (11, text + " o"), (12, text), (20, other), (21, other), (22, other), (23, "alone")]
    docs += [(3, "one under two texts"), (3, other + " p"), (4, "one under two texts"), (20, other + " p x"), (5, text), (None, text), (30, None), (30, "!")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = _rows(ngram_join.classes(df))
    assert got == _classes(docs)
    assert (7, 5, 1, 2) in got and (9, 5, 1, 1) in got and (4, 3, 0, 1) in got and (22, 3, 2, 2) in got and (30, 30, 0, 0) in got
    assert _rows(ngram_join.pairs(df)) == _pairs(docs)


def test_hard_cases(hard, hard_rows):
    assert _rows(ngram_join.classes(hard)) == _classes(hard_rows)


def test_names_that_collide_are_told_apart(spark):
    rng = np.random.default_rng(1)
    names = rng.integers(0, 5, 200, dtype=np.uint64)
    tails = rng.integers(0, 5, 200, dtype=np.uint64)
    first, place = ngram_join._first_of(names, tails)
    pairs = list(zip(names.tolist(), tails.tolist(), strict=True))
    assert [pairs[i] for i in first] == sorted(set(pairs)) and all(pairs[first[p]] == x and pairs.index(x) == first[p] for p, x in zip(place, pairs, strict=True))


@pytest.mark.parametrize("buckets", [1, 7, 51, 200, 70_000, 20_000_000])
def test_buckets_hold_every_token(buckets):
    to = ngram_join.Buckets(buckets)
    tokens = np.concatenate([np.random.default_rng(buckets).integers(0, 1 << 64, 5000, dtype=np.uint64, endpoint=False), np.array([0, (1 << 64) - 1], np.uint64)])
    part, rest = to.split(tokens)
    assert part.min() >= 0 and part.max() < buckets and (rest < np.uint64(1 << 40)).all()
    assert (ngram_join._unpacked(ngram_join._packed(rest, 5), 5) == rest).all()
    back = np.concatenate([to.joined(int(p), rest[k : k + 1]) for k, p in enumerate(part)])
    assert (back >> to.shift).astype(object).tolist() == [int(p) * to.width + (int(r) << int(to.shift)) >> int(to.shift) for p, r in zip(part, rest, strict=True)]
    assert buckets < 1 << 24 or (back == tokens).all()


def test_one_of_each_group_stays(hard, hard_rows):
    kept = ngram_join.drop_near_copies(hard)
    of = brute.components(brute.near_pairs(hard_rows))
    want = sorted(((i is not None, i or 0) for i, _ in hard_rows if i is None or of.get(i, i) == i))
    assert kept.columns == hard.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == want


def test_empty(empty):
    assert ngram_join.classes(empty).count() == 0 and ngram_join.pairs(empty).count() == 0 and ngram_join.drop_near_copies(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {(r["a"], r["b"]) for r in groups.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {(x, r) for x, r in brute.components(p for p in pairs if p[0] != p[1]).items() if x != r}
