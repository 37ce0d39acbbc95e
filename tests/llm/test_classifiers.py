from __future__ import annotations

import random

import numpy as np
import pytest

from sheaf.llm import fm, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_scores_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    x = fm.Rows(np.array([0, 3, 7, 8]), np.array([0, 2, 4, 1, 2, 3, 5, 0], np.int32), rng.normal(size=8).astype(np.float32))
    m = fm.Machine(0.3, rng.normal(size=6).astype(np.float32), rng.normal(size=(6, 4)).astype(np.float32))
    for r, got in enumerate(m.score(x)):
        i, v = x.index[x.start[r] : x.start[r + 1]], x.value[x.start[r] : x.start[r + 1]]
        s = m.bias + sum(m.linear[a] * b for a, b in zip(i, v)) + sum(m.factors[i[a]] @ m.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert abs(got - 1 / (1 + np.exp(-s))) < 1e-5


def test_learns_what_no_sum_of_weights_can_say():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    index = np.stack([a, 2 + b], 1).ravel().astype(np.int32)
    x = fm.Rows(np.arange(0, 8001, 2), index, np.ones(8000, np.float32))
    y = (a ^ b).astype(int)
    m = fm.train(x, y, 4, 4, epochs=20)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95


def test_toxic_by_a_pair_of_terms_that_are_clean_alone(spark):
    rng = random.Random(5)
    filler = [a + b for a in "kiptos merfal dungre walnor beshti cordel zafrin hupmol".split() for b in "ar el is on um".split()]
    docs, toxic = [], []
    for i in range(1200):
        ws = rng.choices(filler, k=rng.randint(8, 40))
        group, insult = rng.random() < 0.3, rng.random() < 0.3
        slur = not group and not insult and rng.random() < 0.43  # so that the share of toxic ones is 0.3 with and without either
        ws += ["groupish"] * group + ["mildly"] * insult + ["slurword"] * slur
        rng.shuffle(ws)
        docs.append((i, " ".join(ws)))
        toxic.append((i, int(group and insult or slur)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    machine = toxicity.fit(df, spark.createDataFrame([t for t in toxic if t[0] % 4], "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(df, machine).collect()}
    held = [(i, t) for i, t in toxic if i % 4 == 0]
    assert np.mean([got[i] == bool(t) for i, t in held]) > 0.97
    pair = [i for i, t in held if t and "slurword" not in docs[i][1]]
    assert len(pair) > 15 and np.mean([got[i] for i in pair]) > 0.9


# Some toxic labels are on documents without any sign of it.
@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.9), (toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learn, check = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    verdict = {"quality": "keep", "toxic": "toxic"}[label]
    rows = module.score(docs, module.fit(docs, learn)).withColumnRenamed(verdict, "verdict").join(check, "doc_id").select("verdict", label).collect()
    y, p = np.array([r[label] for r in rows]), np.array([int(r["verdict"]) for r in rows])
    recall = [(p[y == c] == c).mean() for c in (0, 1)]
    assert np.mean(recall) >= least, recall


def test_hard_cases(spark, hard, empty):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2, "x") for i in range(8)] + [(None, 1, 1, "x"), (100, None, None, "x"), (1, 0, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    q = quality.fit(hard, labels)
    rows = quality.score(hard, q).collect()
    assert len(rows) == hard.count() and all(r["score"] == 0 and not r["keep"] for r in rows if r["doc_id"] in (110, 111, 112, 113, 114))
    kept = quality.keep(hard, q)
    assert kept.columns == hard.columns and kept.count() == sum(r["keep"] for r in rows)
    t = toxicity.score(hard, toxicity.fit(hard, labels)).collect()
    assert len(t) == len(rows) and not any(r["toxic"] for r in t if r["doc_id"] in (110, 111, 112, 113, 114))
    assert quality.score(empty, q).count() == 0 and quality.keep(empty, q).count() == 0 and toxicity.score(empty, None).count() == 0


def test_a_repeated_id_counts_once(spark):
    docs = spark.createDataFrame([(1, "b text here", "en", "s")] * 500 + [(1, "a text here", "en", None)] * 3 + [(2, "two", None, "s"), (None, "x", "en", "s")], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id bigint, quality int")
    x, y = quality.labelled.sample(docs, labels, "quality", 10, ["lang", "source"], quality._features)
    assert len(x) == 2 and y.tolist() == [1, 0]
    one, _ = quality.labelled.sample(docs.where("source is null"), labels, "quality", 10, ["lang", "source"], quality._features)
    assert x.take(np.array([0])).index.tolist() == one.index.tolist()


def test_without_labels_nothing_with_words_is_rejected(spark, hard):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.fit(hard, none) is None and toxicity.fit(hard, none) is None
    rows = quality.score(hard, None).collect()
    assert all(r["keep"] == (r["score"] is None) for r in rows)
    assert not any(r["toxic"] for r in toxicity.score(hard, None).collect())


@pytest.mark.parametrize("rows", [4, 8, 60])
def test_labels_that_no_term_tells_apart_mark_nothing(spark, rows):
    docs = spark.createDataFrame([(i, f"the same words {'and a few' if i % 4 < 2 else 'or others'} each time") for i in range(rows)] + [(None, "clean words")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(rows)], "doc_id bigint, toxic int")
    assert not any(r["toxic"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect())
