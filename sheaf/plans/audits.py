"""Manifest audits over derived state tables, the roll-up, and the incremental snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.catalog import query
from sheaf.operators import audit as A
from sheaf.streaming import refresh
from sheaf.tables import table


def _s(c: str, prefix: str = "") -> F.Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


@query("audit_vendor", """SELECT 'v/' || p_partkey AS local, CASE p_partkey % 5 WHEN 0 THEN 'unexplained' WHEN 1 THEN 'upstream-absent' WHEN 2 THEN 'never-reconciled' WHEN 3 THEN 'upstream-moved' END AS state
    FROM part WHERE p_partkey % 5 <> 4""")
def audit_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    sha = F.sha2("p_name", 256)
    e = p.select(_s("p_partkey", "v/").alias("local"), _s("p_partkey", "u/").alias("upstream"), F.when(k % 5 == 2, None).when(k % 5 == 3, F.sha2(F.lit("old"), 256)).otherwise(sha).alias("upstream_sha256"), F.when(k % 5 == 0, "").otherwise("patched").alias("why"))
    return A.vendored(e, p.where("p_partkey % 5 <> 1").select(_s("p_partkey", "u/").alias("path"), sha.alias("sha256")))


@query("audit_custody", """SELECT 'a/' || o_orderkey AS path, unnest(CASE o_orderkey % 6 WHEN 0 THEN ['missing'] WHEN 1 THEN ['untracked'] WHEN 2 THEN ['unignored-gap', 'counterpart-missing'] WHEN 3 THEN ['counterpart-stale'] WHEN 4 THEN ['counterpart-untracked'] ELSE [] END) AS state FROM orders""")
def audit_custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    artifacts = o.select(_s("o_orderkey", "a/").alias("path"), F.when(k <= 1, "committed").otherwise("encrypted").alias("disposition"), F.when(k >= 2, _s("o_orderkey", "c/")).alias("counterpart"))
    ts = lambda d: F.lit(d).cast("timestamp")
    own = o.where(k != 0).select(_s("o_orderkey", "a/").alias("path"), ts("2024-01-02").alias("mtime"), F.lit(False).alias("tracked"), k.isin(3, 4, 5).alias("ignored"))
    other = o.where(k >= 3).select(_s("o_orderkey", "c/").alias("path"), F.when(k == 3, ts("2024-01-01")).otherwise(ts("2024-01-03")).alias("mtime"), (k != 4).alias("tracked"), F.lit(False).alias("ignored"))
    return A.custody(artifacts, own.unionByName(other))


@query("audit_receipts", "SELECT 'r' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 'receipt-missing' ELSE 'receipt-stale' END AS state FROM customer WHERE c_custkey % 3 IN (0, 1)")
def audit_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    expected = c.select(_s("c_custkey", "r").alias("name"), _s("c_custkey", "p/").alias("path"), F.when(k == 1, 24.0).otherwise(72.0).alias("max_age_hours"))
    return A.receipts(expected, c.where(k != 0).select(_s("c_custkey", "p/").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("mtime")), "2024-01-03")


@query("audit_hooks", "SELECT 's' || s_suppkey AS repo, CASE s_suppkey % 5 WHEN 0 THEN 'hookspath-missing' WHEN 1 THEN 'shadowed' WHEN 2 THEN 'untracked-gate' WHEN 3 THEN 'not-wired' END AS state FROM supplier WHERE s_suppkey % 5 <> 4")
def audit_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    return A.hooks(table(spark, sf_dir, "supplier").select(_s("s_suppkey", "s").alias("repo"), F.lit(".hooks").alias("hooks_path"), (k != 0).alias("path_exists"), (k == 1).alias("shadowed"), (k != 2).alias("tracked"), (k != 3).alias("wired")))


@query("audit_paths", "SELECT 's' || s_suppkey AS path, CASE s_suppkey % 4 WHEN 0 THEN 'worktree-broken' WHEN 1 THEN 'editable-install' WHEN 2 THEN 'broken-link' END AS state FROM supplier WHERE s_suppkey % 4 <> 3")
def audit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    kind = F.element_at(F.array(*map(F.lit, ("worktree", "editable", "symlink", "hookspath"))), (k + 1).cast("int"))
    return A.paths(table(spark, sf_dir, "supplier").select(_s("s_suppkey", "s").alias("path"), kind.alias("kind"), (k == 3).alias("target_exists"), F.lit(False).alias("stale")))


@query("doctor_rollup", """SELECT state, count(*) AS n, string_agg(engine, ',' ORDER BY engine) AS engines FROM (SELECT n_name AS engine, CASE WHEN n_nationkey % 4 = 0 THEN 'ok' WHEN n_nationkey % 4 = 1 AND n_regionkey % 2 = 0 THEN 'fail' WHEN n_nationkey % 4 = 2 THEN 'skipped' ELSE 'error' END AS state FROM nation) GROUP BY state""")
def doctor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return A.rollup(n.select(F.col("n_name").alias("engine"), (F.col("n_nationkey") % 4).alias("exit"), (F.col("n_regionkey") % 2 != 0).alias("advisory")))


@query("snapshot_refresh", """SELECT 'doc-' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 3 = 1 THEN 'changed' END AS action FROM documents WHERE doc_id % 3 <> 2 AND doc_id % 10 <> 9
    UNION ALL SELECT 'doc-' || doc_id, 'removed' FROM documents WHERE doc_id % 10 = 9 AND doc_id % 3 <> 0""")
def snapshot_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    now = d.where(i % 10 != 9).select(_s("doc_id", "doc-").alias("path"), refresh.signature(F.coalesce("text", F.lit(""))).alias("sig"))
    old = d.where(i % 3 != 0).select(_s("doc_id", "doc-").alias("path"), refresh.signature(F.when(i % 3 == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.coalesce("text", F.lit("")))).alias("sig"))
    return refresh.changes(old, now)
