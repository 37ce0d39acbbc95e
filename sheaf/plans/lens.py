"""Notes rendered from the documents table, so that the parsers run on real note text, and the same facts in SQL by
arithmetic alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.tables import table

REGISTER_TIERS = [("system", "system"), ("org", "org")]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of a note for each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    pick = lambda m, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % m + 1).cast("int"))
    dd = F.lpad(s(i % 28 + 1), 2, "0")
    system = F.when(i % 6 == 0, F.concat(F.lit("SYS-"), s(i % 10))).when(i % 6 == 1, F.concat(F.lit("sys "), s(i % 10))).when(i % 6 == 2, F.lit("SYS-1/SYS-2")).when(i % 6 == 3, F.concat(F.lit("ZZZ-"), s(i))).when(i % 6 == 4, F.concat(F.lit("ORG-"), s(i % 3))).otherwise(F.lit("[]"))
    front = F.concat(
        F.lit("---\nlang: "), "lang", F.lit("\ntags: ["), "lang", F.lit(", "), pick(4, "data-set", "data_sets", "Data-Set", "dataset"), F.lit("]\nstatus: "), pick(4, "active", "done", "Draft", "open"),
        F.when(i % 5 != 0, F.concat(F.lit("\nnote_type: "), pick(3, "note", "spec", "misc"))).otherwise(""),
        F.lit("\ndate: 2024-01-"), dd,
        F.when(i % 2 == 0, F.concat(F.when(i % 4 == 0, "\ncreated: 2024-01-").otherwise("\ncreated: 2024-02-"), dd)).otherwise(""),
        F.when(i % 7 == 0, "\nowner: x").otherwise(""), F.lit("\nsystem: "), system, F.lit("\n---\n"),
    )
    body = F.concat(
        F.lit("# Doc "), s(i), F.lit("\n"),
        F.when(i % 5 != 0, F.concat(F.lit("[[doc-"), s((i * 7 + 3) % 1500), F.lit("|see]] "))).otherwise(""),
        F.when(i % 3 == 0, F.concat(F.lit("![[doc-"), s(i % 10), F.lit("#"), F.when(i % 6 == 0, F.concat(F.lit("Doc "), s(i % 10))).otherwise("h"), F.lit("]] "))).otherwise(""),
        F.when(i % 4 == 1, F.concat(F.lit("![[img-"), s(i), F.lit(".png]] "))).otherwise(""),
        F.lit("#tag-"), s(i % 4), F.lit("\n"), F.coalesce("text", F.lit("")),
    )
    return d.select(F.concat("source", F.lit("/doc-"), s(i), F.lit(".md")).alias("path"), F.concat(front, body).alias("text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path) of the notes and of an image for each."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("i"), "source")
    return d.select(F.explode(F.array(F.concat("source", F.lit("/doc-"), "i", F.lit(".md")), F.concat(F.lit("media/img-"), "i", F.lit(".png")))).alias("path"))


SQL = """
    n AS (SELECT doc_id AS i, source, lang, text, source || '/doc-' || doc_id || '.md' AS path FROM documents),
    l AS (SELECT i, path AS src, 'doc-' || (i * 7 + 3) % 1500 AS target, '' AS anchor, 'see' AS alias, false AS embed, (i * 7 + 3) % 1500 AS t FROM n WHERE i % 5 <> 0
          UNION ALL SELECT i, path, 'doc-' || i % 10, CASE WHEN i % 6 = 0 THEN 'Doc ' || i % 10 ELSE 'h' END, '', true, i % 10 FROM n WHERE i % 3 = 0
          UNION ALL SELECT i, path, 'img-' || i || '.png', '', '', true, NULL FROM n WHERE i % 4 = 1),
    r AS (SELECT l.*, CASE WHEN l.t IS NULL THEN 'media/img-' || l.i || '.png' ELSE n.path END AS dst FROM l LEFT JOIN n ON n.i = l.t),
    deg AS (SELECT path, sum(a)::BIGINT AS inbound, sum(b)::BIGINT AS outbound
            FROM (SELECT path, 0 AS a, 0 AS b FROM n UNION ALL SELECT dst, 1, 0 FROM r WHERE dst LIKE '%.md' UNION ALL SELECT src, 0, 1 FROM r)
            GROUP BY path)"""


def sql(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([SQL.strip(), *more]) + "\n" + select


def fields_sql() -> str:
    """The front matter's fields by arithmetic."""
    return """
    f AS (SELECT path, i, 'lang' AS field, lang AS value FROM n
          UNION ALL SELECT path, i, 'status', ['active', 'done', 'Draft', 'open'][i % 4 + 1] FROM n
          UNION ALL SELECT path, i, 'note_type', ['note', 'spec', 'misc'][i % 3 + 1] FROM n WHERE i % 5 <> 0
          UNION ALL SELECT path, i, 'date', '2024-01-' || lpad((i % 28 + 1)::VARCHAR, 2, '0') FROM n
          UNION ALL SELECT path, i, 'created', CASE WHEN i % 4 = 0 THEN '2024-01-' ELSE '2024-02-' END || lpad((i % 28 + 1)::VARCHAR, 2, '0') FROM n WHERE i % 2 = 0
          UNION ALL SELECT path, i, 'owner', 'x' FROM n WHERE i % 7 = 0
          UNION ALL SELECT path, i, 'system', CASE i % 6 WHEN 0 THEN 'SYS-' || i % 10 WHEN 1 THEN 'sys ' || i % 10 WHEN 2 THEN 'SYS-1/SYS-2' WHEN 3 THEN 'ZZZ-' || i WHEN 4 THEN 'ORG-' || i % 3 END
                    FROM n WHERE i % 6 <> 5)"""
