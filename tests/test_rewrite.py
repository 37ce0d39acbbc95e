from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sheaf.operators import rewrite as W
from sheaf.sources import files as S


@pytest.mark.parametrize(("text", "want"), [
    ("[[a]] [[a|x]] ![[a#h]] [[dir/a]] [[ab]] a", "[[b]] [[b|x]] ![[b#h]] [[dir/b]] [[c$1]] a"),
    ("[[b]]", "[[c]]"),
    ("[[A]] [[a.md]] [[a\\|t]]", "[[b]] [[b.md]] [[b\\|t]]"),
    ("none [[z]]", None),
])
def test_renames_do_not_feed_one_another(spark, text, want):
    notes = spark.createDataFrame([("n.md", text)], "path string, text string")
    got = W.links(notes, spark.createDataFrame([("a", "b"), ("b", "c"), ("ab", "c$1")], "stem string, new_stem string")).first()
    assert (got and got["new"]) == want


@pytest.mark.parametrize(("value", "want"), [("plain words", "plain words"), ("yes", '"yes"'), ("2024-01-01", '"2024-01-01"'), ('a "b"', '"a \\"b\\""'), ("x: y", '"x: y"'), ("back\\slash", '"back\\\\slash"')])
def test_scalars(spark, value, want):
    assert spark.range(1).select(W.scalar(F.lit(value)).alias("x")).first()["x"] == want


def test_slug(spark):
    d = spark.createDataFrame([("Été à  la_mer!",), ("x" * 80,), (None,), ("---",)], "t string")
    assert [r["s"] for r in d.select(W.slug(F.col("t")).alias("s")).collect()] == ["ete-a-la-mer", "x" * 60, None, ""]


def test_index_lint_spares_links_and_code(spark):
    d = spark.createDataFrame([(1, "- [[a — b]] `->` fine"), (2, "- bad — dash"), (3, "- bad -> arrow"), (4, "- " + "x" * 300), (5, "text — no entry")], "line int, text string")
    assert sorted(tuple(r) for r in W.index_lint(d).collect()) == [(2, "dash"), (3, "arrow"), (4, "long")]


def test_references_in_both_forms(spark):
    d = spark.createDataFrame([("a.md", "[[b]] (sub/b.md) [[a]]"), ("b.md", "(a.md)"), ("c.md", None)], "path string, text string")
    assert {tuple(r) for r in W.inbound(d).collect()} == {("a.md", 1), ("b.md", 1), ("c.md", 0)}


def test_pins_and_headers(spark):
    d = spark.createDataFrame([("r.md", "use tool@v1.2.3 now\nor tool 1.3\nnothing"), ("e.py", "# @capability: audit x\nx = 1")], "path string, text string")
    assert [tuple(r) for r in W.pins(d, "tool").orderBy("line").collect()] == [("r.md", 1, "1.2.3"), ("r.md", 2, "1.3")]
    assert [tuple(r) for r in S.headers(d).collect()] == [("e.py", "capability", "audit x")]


def test_slug_query_reads_whole_texts(spark, tmp_path):
    from sheaf.plans import rewrites

    spark.createDataFrame([(1, "- " * 200 + "Été à la mer")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["slug"] for r in rewrites.slug_nfkd(spark, str(tmp_path)).collect()] == ["ete-a-la-mer"]
