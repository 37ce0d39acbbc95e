"""Link graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.catalog import query
from sheaf.functions import notes as N
from sheaf.functions import text as T
from sheaf.operators import findings as FI
from sheaf.operators import graph as G
from sheaf.plans import lens
from sheaf.sources import files as S
from sheaf.tables import table


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve(N.all_links(lens.notes(spark, sf_dir)), lens.files(spark, sf_dir))


def _note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.files(spark, sf_dir).where(F.col("path").endswith(".md"))


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_note_files(spark, sf_dir), _resolved(spark, sf_dir)).where(F.col("path").endswith(".md"))


@query("graph_links", lens.sql("SELECT src, target, anchor, alias, embed FROM l"))
def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.links(lens.notes(spark, sf_dir)).drop("pos")


@query("graph_resolved", lens.sql("SELECT src, target, dst FROM r WHERE dst IS NOT NULL"))
def graph_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("dst is not null").select("src", "target", "dst")


@query("graph_broken_links", lens.sql("SELECT src, target FROM r WHERE dst IS NULL"))
def graph_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("state = 'broken'").select("src", "target")


@query("graph_degree", lens.sql("SELECT path, inbound, outbound FROM deg"))
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degrees(spark, sf_dir)


@query("graph_orphans", lens.sql("SELECT path FROM deg WHERE inbound = 0"))
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degrees(spark, sf_dir).where("inbound = 0").select("path")


@query("graph_dead_ends", lens.sql("SELECT path FROM deg WHERE outbound = 0"))
def graph_dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degrees(spark, sf_dir).where("outbound = 0").select("path")


@query("graph_isolated", lens.sql("SELECT path FROM deg WHERE inbound = 0 AND outbound = 0"))
def graph_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degrees(spark, sf_dir).where("inbound = 0 and outbound = 0").select("path")


@query("graph_broken_anchors", lens.sql("SELECT src, dst, anchor FROM r WHERE anchor = 'h' AND dst IS NOT NULL"))
def graph_broken_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.broken_anchors(_resolved(spark, sf_dir), lens.notes(spark, sf_dir))


@query("graph_orphan_media", lens.sql("SELECT 'media/img-' || i || '.png' AS path FROM n WHERE i % 4 <> 1"))
def graph_orphan_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.orphan_media(lens.files(spark, sf_dir), _resolved(spark, sf_dir))


@query("graph_stem_collisions", "SELECT 'd-' || doc_id % 97 AS stem, count(*) AS n, string_agg(source || '/d-' || doc_id % 97 || '.md', ',' ORDER BY source || '/d-' || doc_id % 97 || '.md') AS paths FROM documents GROUP BY ALL HAVING count(*) > 1")
def graph_stem_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return G.stem_collisions(d.select(F.concat("source", F.lit("/d-"), (F.col("doc_id") % 97).cast("string"), F.lit(".md")).alias("path")))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = graph_broken_links(spark, sf_dir).withColumnRenamed("src", "path")
    return b.withColumn("fingerprint", T.fingerprint("broken_link", F.col("target")))


_BASE = "base AS (SELECT DISTINCT 'broken_link|doc-' || (i * 7 + 3) % 1500 AS fingerprint FROM n WHERE i % 3 <> 0), fp AS (SELECT src AS path, target, 'broken_link|' || target AS fingerprint FROM r WHERE dst IS NULL)"


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run would have listed: fingerprints made from the ids of two documents of three."""
    d = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    return d.select(F.concat(F.lit("broken_link|doc-"), ((F.col("doc_id") * 7 + 3) % 1500).cast("string")).alias("fingerprint")).distinct()


@query("graph_net_new", lens.sql("SELECT path, target, fingerprint FROM fp WHERE fingerprint NOT IN (SELECT fingerprint FROM base)", _BASE))
def graph_net_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.net_new(_broken(spark, sf_dir), _baseline(spark, sf_dir))


@query("graph_baseline_resolved", lens.sql("SELECT fingerprint FROM base EXCEPT SELECT fingerprint FROM fp", _BASE))
def graph_baseline_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(spark, sf_dir).subtract(_broken(spark, sf_dir).select("fingerprint"))


@query("graph_scoped", lens.sql("SELECT in_scope, count(*) AS n FROM (SELECT path IN (SELECT path FROM n WHERE i % 11 = 0) AS in_scope FROM fp) GROUP BY ALL", _BASE))
def graph_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 11 = 0")
    changes = d.select(F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return G.scoped(_broken(spark, sf_dir), changes).groupBy("in_scope").agg(F.count("*").alias("n"))


@query("graph_findings", lens.sql("SELECT 'graph' AS engine, 'broken_link' AS rule, 'warning' AS severity, path, 1 AS line, 'no file for ' || target AS message, fingerprint FROM fp", _BASE))
def graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.findings(_broken(spark, sf_dir), "graph", "broken_link", "path", F.concat(F.lit("no file for "), "target"), fingerprint=F.col("fingerprint"))


@query("findings_sarif")
def findings_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.sarif(graph_findings(spark, sf_dir))


#: A collection with the cases that the rendered notes lack; what is to be found in it is written down below, not computed.
_CASES = {
    "a.md": "[[#Here]] [[https://x.org/p]] [web](https://x.org) [mail](mailto:a@b.c) [[b]] [[dir\\b]] [[old/b]] [text](dir/b.md#Top \"t\") ![[pic]] ![[pic.png]] [here](#Here)",
    "b.md": "# Top\n[[dir/b#Top]] [[dir/b#Nope]] [[b#^id1]] [[b#^id2]]\nline ^id1\n",
    "dir/b.md": "## Top\n```\n[[fenced]]\n```\n",
    "only-broken.md": "[[nowhere]] [[dir/nowhere]] [gone](gone.md)",
    "v1.2.md": "[[V1.2]] [[Spec v2.0]] [[x.7z]]",
    "alone.md": "no link",
    "sub/Spec v2.0.md": "[[v1.2.md]] [[./b]] [[SUB/spec V2.0]]",
    "board.canvas": '{"nodes": [{"id": "1", "type": "file", "file": "dir/b.md"}, {"id": "2", "type": "file", "file": "lost.md"}, {"id": "3", "type": "text"}]}',
    "view.base": "filter: 'b.md' or \"lost.png\"",
    "pic.png": None,
}


def _cases(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    texts = spark.createDataFrame([(p, t) for p, t in _CASES.items() if t is not None], "path string, text string")
    return texts, spark.createDataFrame([(p,) for p in _CASES], "path string")


@query("graph_cases", """SELECT * FROM (VALUES ('a.md', 'https://x.org/p', NULL, 'external'), ('a.md', 'https://x.org', NULL, 'external'), ('a.md', 'mailto:a@b.c', NULL, 'external'), ('a.md', 'b', 'b.md', 'found'),
        ('a.md', 'dir\\b', 'dir/b.md', 'found'), ('a.md', 'old/b', 'b.md', 'found'), ('a.md', 'dir/b.md', 'dir/b.md', 'found'), ('a.md', 'pic', NULL, 'broken'), ('a.md', 'pic.png', 'pic.png', 'found'),
        ('b.md', 'dir/b', 'dir/b.md', 'found'), ('b.md', 'dir/b', 'dir/b.md', 'found'), ('b.md', 'b', 'b.md', 'found'), ('b.md', 'b', 'b.md', 'found'),
        ('only-broken.md', 'nowhere', NULL, 'broken'), ('only-broken.md', 'dir/nowhere', NULL, 'broken'), ('only-broken.md', 'gone.md', NULL, 'broken'),
        ('v1.2.md', 'V1.2', 'v1.2.md', 'found'), ('v1.2.md', 'Spec v2.0', 'sub/Spec v2.0.md', 'found'), ('v1.2.md', 'x.7z', NULL, 'broken'),
        ('sub/Spec v2.0.md', 'v1.2.md', 'v1.2.md', 'found'), ('sub/Spec v2.0.md', './b', 'b.md', 'found'), ('sub/Spec v2.0.md', 'SUB/spec V2.0', 'sub/Spec v2.0.md', 'found')) v(src, target, dst, state)""")
def graph_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, files = _cases(spark)
    return G.resolve(N.all_links(texts.where("path like '%.md'")), files).select("src", "target", "dst", "state")


@query("graph_cases_degree", """SELECT path, i::BIGINT AS inbound, o::BIGINT AS outbound FROM (VALUES ('a.md', 0, 9), ('b.md', 5, 4), ('dir/b.md', 4, 0), ('only-broken.md', 0, 3), ('v1.2.md', 2, 3), ('alone.md', 0, 0), ('sub/Spec v2.0.md', 2, 3)) v(path, i, o)""")
def graph_cases_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, files = _cases(spark)
    return G.degrees(files.where("path like '%.md'"), G.resolve(N.all_links(texts.where("path like '%.md'")), files))


@query("graph_cases_anchors", "SELECT * FROM (VALUES ('b.md', 'dir/b.md', 'Nope'), ('b.md', 'b.md', '^id2')) v(src, dst, anchor)")
def graph_cases_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, files = _cases(spark)
    notes = texts.where("path like '%.md'")
    return G.broken_anchors(G.resolve(N.all_links(notes), files), notes)


@query("graph_cases_views", "SELECT * FROM (VALUES ('board.canvas', 'dir/b.md', 'found'), ('board.canvas', 'lost.md', 'broken'), ('view.base', 'b.md', 'found'), ('view.base', 'lost.png', 'broken')) v(src, target, state)")
def graph_cases_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that canvases and views name."""
    texts, files = _cases(spark)
    return G.resolve(S.canvas_links(texts).unionByName(S.base_links(texts)), files).select("src", "target", "state")


@query("html_links", """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) GROUP BY ALL""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(T.matches(F.col("html"), 'href="([^"]+)"', 1)).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))
