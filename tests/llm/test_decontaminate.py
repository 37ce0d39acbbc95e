from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from sheaf.llm import decontaminate as D
from tests.llm import brute


def _fixture():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghijklmnop")
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(12)]
    items += [(3, items[3][1]), (4, "another text of item four, which is long enough"), (None, "an item without any number has its words too"), (50, ""), (51, None), (52, "?!")]
    docs = []
    for i in range(80):
        ws = [word() for _ in range(rng.randint(0, 60))]
        t = items[rng.randrange(len(items))][1]
        if t and rng.random() < 0.6:
            part = t.split()
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = word()
            at = rng.randint(0, len(ws))
            ws[at:at] = part
        docs.append((i, " ".join(ws)))
    return items, docs


def _got(found):
    return {(r["doc_id"], r["item_id"], r["matched"], r["size"], r["position"]) for r in found.collect()}


def test_against_brute_force(spark, monkeypatch):
    items, docs = _fixture()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute.contained(docs, items)
    assert len(want) > 30 and _got(D.contaminated(d, b)) == want
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", 0)
    assert _got(D.contaminated(d, b)) == want


def test_hard_cases(spark, hard, hard_rows):
    items = [(1, hard_rows[4][1]), (2, "new end"), (3, "don't"), (4, None), (None, "one under two texts")]
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, run string")
    want = brute.contained(hard_rows, items)
    assert _got(D.contaminated(hard, b)) == want
    kept = D.drop_contaminated(hard, b)
    gone = {r[0] for r in want}
    assert kept.columns == hard.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(i) for i, _ in hard_rows if i not in gone)


def test_pipeline_drops_texts_not_ids(spark, hard, hard_rows, tmp_path):
    items = [(1, hard_rows[4][1]), (2, "new end"), (3, "don't"), (None, "one under two texts")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.benchmark(spark, hard, str(tmp_path))
    want = [r for r in hard_rows if not brute.contained([r], items)]
    assert (120, "the other of two texts") in want and (None, None) in want and len(want) < len(hard_rows)
    assert kept.columns == hard.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want)


def test_empty(spark, hard, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")
    assert D.contaminated(hard, none).count() == 0 and D.contaminated(empty, some).count() == 0
    assert D.drop_contaminated(hard, none).count() == hard.count() and D.drop_contaminated(empty, some).count() == 0


def test_many_hits_take_no_quadratic_time():
    import time

    n = 60_000
    row = {"doc_id": 1, "name": 2, "item_id": 3, "length": 12, "span": 3, "need": 6, "prefix": 5, "item": list(range(10)), "positions": list(range(0, 4 * n, 4)), "runs": [i % 10 for i in range(n)]}
    schema = D.pa.Table.from_pylist([row]).schema
    began = time.process_time()
    assert list(D._windows(iter([D.pa.RecordBatch.from_pylist([row], schema=schema)]))) == []
    assert time.process_time() - began < 10
