from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from sheaf.llm import kernel, langid

SF = "/root/testdata/sf0.01"


def _brute(text: str) -> Counter:
    """Hashed n-grams of a text, one after the other."""
    b = [c if 97 <= c <= 122 or c >= 128 else 0 for c in text.encode()]
    out: Counter = Counter()
    shift = 32 - langid.HASHED.bit_length() + 1
    for i in range(len(b) - 1):
        if b[i] | b[i + 1]:
            out[((b[i] << 8 | b[i + 1]) + 1) * 2654435761 % (1 << 32) >> shift] += 1
    for i in range(len(b) - 2):
        if b[i] | b[i + 1] | b[i + 2]:
            out[((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) + (1 << 24)) * 2654435761 % (1 << 32) >> shift] += 1
    return out


def test_counts_against_brute_force(monkeypatch):
    texts = ["one two", "", "é", "a", "été là-bas 12", "x" * 50, "zwei drei vier " * 9]
    for chunk in (7, 1 << 19):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        got = langid.counts(*kernel.buffers(pa.array(texts)))
        assert all({int(k): int(r[k]) for k in np.flatnonzero(r)} == _brute(t) for r, t in zip(got, texts, strict=True))


def test_against_brute_force_and_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    held = {r["doc_id"]: r for r in docs.where("doc_id % 2 = 1").collect()}
    got = langid.classify(docs.where("doc_id % 2 = 1"), model).collect()
    right = [r["lang_id"] == held[r["doc_id"]]["lang"] for r in got]
    assert len(got) == len(held) and np.mean(right) > 0.98
    for r in got[:40]:
        v = {k: math.log1p(n) * float(model.idf[k]) for k, n in _brute(held[r["doc_id"]]["text"].lower()).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in model.vectors]
        assert abs(max(cosine) - r["cosine"]) < 1e-4 and model.languages[int(np.argmax(cosine))] == r["nearest"]


def test_document_frequencies_cover_all_documents(spark):
    docs = spark.createDataFrame([(i, "same words", "en") for i in range(50)] + [(99, "other", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, sample=5)
    key = next(iter(_brute("same")))
    assert abs(float(model.idf[key]) - (math.log(52 / 51) + 1)) < 1e-5


def test_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "щось зовсім інше написано тут"), (2, "12345 67890 !!!"), (3, "xq zxqj vvkq qqqz xjxj kqzx")], "doc_id bigint, text string")
    assert all(r["lang_id"] is None for r in langid.classify(odd, model).collect())


def test_hard_cases(hard, empty):
    model = langid.fit(hard)
    rows = langid.classify(hard, model).collect()
    assert len(rows) == hard.count()
    assert all(r["lang_id"] is None and r["cosine"] == 0 for r in rows if r["doc_id"] in (110, 111, 112, 113, 114))
    assert langid.classify(empty, model).count() == 0
    none = langid.fit(empty)
    assert all(r["lang_id"] is None for r in langid.classify(hard, none).collect())
