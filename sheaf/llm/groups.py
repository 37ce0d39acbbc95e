"""Connected components of a graph given as pairs, by contracting stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import common


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with ``low``, the least b of each a.  The least is found by an aggregation that begins before the shuffle, and
    joined back: the many edges of a hub are never one group in one task, as a skewed join is split."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("low")), "a")


def _large(edges: DataFrame) -> DataFrame:
    """Every vertex hands its greater neighbours to the least of itself and its neighbours."""
    both = _with_least(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return both.where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every vertex hands itself and its lesser neighbours to the least of these; ``a`` is the greater of each edge."""
    handed = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    return handed.select("b", "low").unionByName(handed.select(F.col("a").alias("b"), "low")).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(a, b) for each vertex a of ``pairs`` (a, b) that isn't the least of its component; b is that least vertex.

    Each round halves at least the depth of what isn't yet a star, and is kept by a checkpoint, so that the lineage doesn't
    grow.  Pairs of a vertex with itself, and with null, don't count."""
    edges = common.cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def sign(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = sign(edges)
    while True:
        edges = common.cut(_small(_large(edges)))
        before, now = now, sign(edges)
        if now == before:
            return edges
