from __future__ import annotations

import hashlib
import random
from collections import Counter

from sheaf.llm import exact_dedup as E
from tests.llm import brute


def _digest(i: int) -> bytes:
    return hashlib.sha256(str(i).encode()).digest()


def test_filter_inserts_finds_deletes_and_grows():
    index, live, rng = E.CuckooIndex(2), Counter(), random.Random(5)
    for _ in range(6000):
        i = rng.randrange(1500)
        if rng.random() < 0.55:
            assert index.insert(_digest(i), i) == (not live[i])
            live[i] += 1
        else:
            assert index.delete(_digest(i)) == (live[i] > 0)
            live[i] = max(0, live[i] - 1)
    assert index.resizes > 3
    assert all(index.find(_digest(i)) == (live[i] > 0, i if live[i] else None) for i in range(1500))
    assert len(index.keys) == sum(n > 0 for n in live.values()) and all(index.keys[_digest(i)][1] == n for i, n in live.items() if n)
    again = E.CuckooIndex.from_bytes(index.to_bytes())
    assert again.keys == index.keys and all(again.maybe(d) for d in index.keys)


def test_filter_hits_are_verified():
    index = E.CuckooIndex()
    one = _digest(1)
    other = one[:10] + bytes(22)  # the same homes and fingerprint
    index.insert(one, 1)
    assert index.maybe(other) and index.find(other) == (False, None)
    assert index.insert(other, 2) and index.delete(other) and index.find(one) == (True, 1)


def test_against_brute_force(hard, hard_rows):
    got = Counter(map(tuple, E.exact_dedup(hard).collect()))
    assert got == Counter((i, *brute.copies(hard_rows)[k]) for k, (i, _) in enumerate(hard_rows))


def test_drop_copies_keeps_one_of_each_and_all_columns(hard, hard_rows):
    kept = E.drop_copies(hard)
    assert kept.columns == hard.columns
    want = Counter(r for k, r in enumerate(hard_rows) if brute.copies(hard_rows)[k][1])
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert {t for _, t in got} == {t for _, t in want} and got == want


def test_equal_texts_under_null_ids_only(spark):
    rows = [(None, "one"), (None, "one"), (None, "one"), (None, "two"), (1, "three"), (None, "three"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, E.exact_dedup(df).collect())) == Counter((i, *brute.copies(rows)[k]) for k, (i, _) in enumerate(rows))
    assert Counter(map(tuple, E.drop_copies(df).collect())) == Counter(r for k, r in enumerate(rows) if brute.copies(rows)[k][1])


def test_empty(empty):
    assert E.exact_dedup(empty).count() == 0 and E.drop_copies(empty).count() == 0


def test_index_is_carried_on(spark):
    keys = lambda *ids: spark.createDataFrame([(bytearray(_digest(i)), i) for i in ids], "digest binary, doc_id bigint")
    index = E.change(keys(1, 2, 3), buckets=3).cache()
    assert index.where("op = 0").count() == 3
    index = E.change(keys(2), index, delete=True, buckets=3).cache()
    assert index.where("op = 1 and first_id = 2").count() == 1
    last = E.change(keys(2, 3), index, buckets=3)
    assert {(r["op"], r["doc_id"]) for r in last.where("op >= 0").collect()} == {(0, 2), (2, 3)}


def test_a_digest_lives_as_long_as_one_of_its_documents(spark):
    keys = lambda *ids: spark.createDataFrame([(bytearray(_digest(0)), i) for i in ids], "digest binary, doc_id bigint")
    one = E.change(keys(1, 2), buckets=2).cache()
    two = E.change(keys(2), one, delete=True, buckets=2).cache()  # a copy goes
    assert [(r["op"], r["first_id"]) for r in E.change(keys(3), two, buckets=2).where("op >= 0").collect()] == [(2, 1)]
    three = E.change(keys(1), one, delete=True, buckets=2).cache()  # the one that was kept goes, its copy doesn't
    assert [(r["op"], r["first_id"]) for r in E.change(keys(3), three, buckets=2).where("op >= 0").collect()] == [(2, 1)]
    none = E.change(keys(2), three, delete=True, buckets=2).cache()
    assert [(r["op"], r["first_id"]) for r in E.change(keys(3), none, buckets=2).where("op >= 0").collect()] == [(0, 3)]
    assert [r["first_id"] for r in E.change(keys(3), none, delete=True, buckets=2).where("op >= 0").collect()] == [None]


def test_many_copies_reach_the_index_once_for_each_task(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else cast(id as string) end as text").repartition(4)
    local = E.digests(df).transform(E.kernel.arrow, E._first_here, "digest binary, doc_id bigint, n bigint, same bigint").groupBy("digest").agg({"*": "count", "n": "sum", "doc_id": "min"}).collect()
    assert max(r["count(1)"] for r in local) <= 4 and sorted(r["sum(n)"] for r in local)[-1] == 6667
    assert E.exact_dedup(df).where("not keep and first_id = 0").count() == 6666


def test_shuffled_instead_of_broadcast(hard, hard_rows, monkeypatch):
    monkeypatch.setattr(E, "BROADCAST_DIGESTS", -1)
    got = Counter(map(tuple, E.exact_dedup(hard).collect()))
    assert got == Counter((i, *brute.copies(hard_rows)[k]) for k, (i, _) in enumerate(hard_rows))
    assert Counter((r["doc_id"], r["text"]) for r in E.drop_copies(hard).collect()) == Counter(r for k, r in enumerate(hard_rows) if brute.copies(hard_rows)[k][1])
