from __future__ import annotations

import corpus_pipeline as P
from pyspark.sql import functions as F
from sheaf.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from tests.llm import brute


def _step(spark, tmp_path, df, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_every_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(P.STAGES):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = _step(spark, tmp_path, stage(spark, docs, sf), name)
        ids = sorted(r["doc_id"] for r in out.collect())
        if k == 0:
            m = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            want = [r["doc_id"] for r in quality.score(docs, m).where("keep").collect()]
        elif k == 1:
            want = [rows[i][0] for i, (_, keep) in brute.copies(rows).items() if keep]
        elif k == 2:
            of = brute.components(brute.near_pairs(rows))
            want = [i for i, _ in rows if of.get(i, i) == i]
        elif k == 3:
            gone = {r[0] for r in brute.contained(rows, items)}
            want = [i for i, _ in rows if i not in gone]
        else:
            want = [i for i, _ in rows]
            back = {r["doc_id"]: r["text"] for r in bpe.decode(out).collect()}
            assert back == dict(rows) and out.where("exact").count() == len(rows)
        assert ids == sorted(want), name
        assert k == len(P.STAGES) - 1 or out.columns == columns
        docs = out
    assert {r["doc_id"] for r in P.run(spark, sf).collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_take_hard_cases_and_empty_tables(spark, sf, hard, empty):
    for _, stage in P.STAGES:
        assert stage(spark, hard, sf).count() <= hard.count()
        assert stage(spark, empty, sf).count() == 0


def test_stages_name_the_operators():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe_encoding"]
    assert F and decontaminate and exact_dedup and ngram_join
