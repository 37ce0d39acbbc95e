"""Queries of changes to notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.catalog import query
from sheaf.functions import notes as N
from sheaf.operators import rewrite as W
from sheaf.plans import lens
from sheaf.tables import table


@query("link_rewrites", lens.sql("SELECT src AS path, CASE WHEN t % 2 = 0 AND t IN (SELECT i FROM n) THEN 'note-' || t ELSE target END AS target FROM l WHERE src IN (SELECT src FROM l WHERE t % 2 = 0 AND t IN (SELECT i FROM n))"))
def link_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("i"))
    new = W.links(lens.notes(spark, sf_dir), even.select(F.concat(F.lit("doc-"), "i").alias("stem"), F.concat(F.lit("note-"), "i").alias("new_stem")))
    return N.links(new.select("path", F.col("new").alias("text"))).select(F.col("src").alias("path"), "target")


@query("fm_guard", lens.sql("SELECT path, 'status' AS field, 4 AS line, i % 3 <> 1 AS introduced FROM n WHERE i % 4 = 2"))
def fm_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.fields(lens.notes(spark, sf_dir)).where("field = 'status' and value = 'Draft'").select("path", "field", "line")
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    changes = d.select(F.concat("source", F.lit("/doc-"), i.cast("string"), F.lit(".md")).alias("path"), F.when(i % 3 == 0, 4).when(i % 3 == 1, 99).alias("line"))
    return W.guard(found, changes)


@query("mem_inbound", lens.sql("SELECT n.path, count(DISTINCT CASE WHEN r.src <> n.path THEN r.src END) AS refs FROM n LEFT JOIN r ON r.dst = n.path GROUP BY n.path"))
def mem_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.inbound(lens.notes(spark, sf_dir))


@query("fm_render", """SELECT doc_id, '---' || chr(10) || 'lang: ' || lang || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'created: "2024-01-02"' || chr(10) END || 'tags: [' || lang || ', ' || source || ']' || chr(10) || '---' || chr(10) AS block FROM documents""")
def fm_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    block = W.front_matter({"lang": F.col("lang"), "created": F.when(F.col("doc_id") % 3 != 0, F.lit("2024-01-02")).otherwise(""), "none": F.lit(None).cast("string")}, {"tags": F.array("lang", "source"), "aliases": F.array().cast("array<string>")})
    return d.select("doc_id", block.alias("block"))


@query("slug_nfkd")
def slug_nfkd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", W.slug(F.col("text")).alias("slug"))


@query("ingest_deadlines", """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN DATE '2024-03-01' WHEN 1 THEN DATE '2024-01-11' WHEN 2 THEN DATE '2024-01-10' + (turn * 7)::INTEGER END AS due FROM conversations""")
def ingest_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    phrase = F.when(c % 4 == 0, "by 2024-03-01").when(c % 4 == 1, "Tomorrow please").when(c % 4 == 2, F.concat(F.lit("in "), t.cast("string"), F.lit(" weeks"))).otherwise("soon")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", W.deadline(phrase, F.lit("2024-01-10").cast("date")).alias("due"))


@query("mem_snoozed", "SELECT c_custkey, c_custkey % 4 IN (0, 1) AS snoozed FROM customer")
def mem_snoozed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    reviewed = F.when(k == 0, "2024-05-01").when(k == 1, "'2023-01-01'").when(k == 2, "2024-01-01").otherwise("never")
    return table(spark, sf_dir, "customer").select("c_custkey", W.snoozed(reviewed, F.when(k == 1, "900"), "2024-06-01").alias("snoozed"))


@query("corr_records_index", lens.sql("SELECT target AS value, count(DISTINCT src) AS n_notes FROM l WHERE t IS NOT NULL GROUP BY target"))
def corr_records_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = N.links(lens.notes(spark, sf_dir)).where(F.col("target").rlike("^doc-[0-9]+$"))
    return n.select("src", F.col("target").alias("value")).distinct().groupBy("value").agg(F.count("*").alias("n_notes"))
