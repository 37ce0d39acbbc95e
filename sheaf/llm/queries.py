"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import bpe, decontaminate, exact_dedup, html, langid, licenses, ngram_join, quality, toxicity, warc
from sheaf.tables import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.classify(docs, langid.fit(docs))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(warc.records(table(spark, sf_dir, "pages")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_bpe": op3_bpe,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_html_extraction": op6_html_extraction,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS first_id,
               text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS keep
        FROM documents""",
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE
             w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\x7f]+'), lambda x: x <> '') AS ws
                   FROM documents WHERE doc_id IS NOT NULL),
             g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                          ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS s
                   FROM w WHERE len(ws) > 0),
             r AS (SELECT s, row_number() OVER () AS k, min(doc_id) AS rep, count(*) AS n FROM g GROUP BY s),
             t AS (SELECT k, len(s) AS n, unnest(s) AS t FROM r),
             o AS (SELECT a.k AS a, b.k AS b, a.n + b.n AS n, count(*) AS i FROM t a JOIN t b ON a.t = b.t AND a.k <> b.k GROUP BY ALL),
             p AS (SELECT a, b FROM o WHERE 2 * i >= n - i),
             m AS (SELECT doc_id, k, rep, n FROM g JOIN r USING (s)),
             e AS (SELECT x.rep AS a, y.rep AS b FROM p JOIN r x ON x.k = a JOIN r y ON y.k = b
                   UNION SELECT doc_id, rep FROM m UNION SELECT rep, doc_id FROM m),
             c(a, b) AS (SELECT a, a FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
             l AS (SELECT a AS k, count(*) AS links FROM p GROUP BY a)
        SELECT d.doc_id, coalesce(any_value(q.b), d.doc_id) AS class_id, sum(coalesce(links, 0))::BIGINT AS links, sum(coalesce(n - 1, 0))::BIGINT AS copies
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN (SELECT a, min(b) AS b FROM c GROUP BY a) q ON q.a = d.doc_id
             LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN l ON l.k = m.k
        GROUP BY d.doc_id""",
    "op9_warc": """
        SELECT page_id AS record_id, sha256(html) AS digest, octet_length(encode(html))::BIGINT AS length,
               sha256('WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' || page_id || '>\r\nWARC-Target-URI: ' || url
                      || '\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:' || sha256(html)
                      || '\r\nContent-Length: ' || octet_length(encode(html)) || '\r\n\r\n' || html) AS record_sha256,
               true AS verified, true AS declared_ok
        FROM pages""",
    "op10_benchmark_decontamination": r"""
        WITH iw AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\x7f]+'), lambda x: x <> '') AS ws
                    FROM benchmark WHERE text IS NOT NULL),
             items AS (SELECT row_number() OVER () AS k, item_id, len(ws) AS n, least(len(ws), 3) AS span,
                              list_distinct(list_transform(range(1, len(ws) - least(len(ws), 3) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 3) - 1], ' '))) AS s
                       FROM iw WHERE len(ws) > 0),
             runs AS (SELECT k, span, unnest(s) AS t FROM items),
             dw AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\x7f]+'), lambda x: x <> '') AS ws
                    FROM documents WHERE text IS NOT NULL),
             d AS (SELECT row_number() OVER () AS dk, doc_id, ws FROM dw WHERE len(ws) > 0),
             p AS (SELECT dk, doc_id, span, unnest(range(0, len(ws) - span + 1)) AS p, ws FROM d, (SELECT DISTINCT span FROM runs) WHERE len(ws) >= span),
             x AS (SELECT dk, doc_id, span, p, array_to_string(ws[p + 1:p + span], ' ') AS t FROM p),
             hits AS (SELECT dk, doc_id, k, p, t FROM x JOIN runs USING (span, t)),
             w AS (SELECT a.dk, a.doc_id, a.k, a.p, count(DISTINCT b.t) AS c
                   FROM (SELECT DISTINCT dk, doc_id, k, p FROM hits) a JOIN items USING (k) JOIN hits b ON a.dk = b.dk AND a.k = b.k AND b.p BETWEEN a.p AND a.p + items.n - items.span
                   GROUP BY ALL),
             best AS (SELECT dk, doc_id, k, max(c) AS c, arg_min(p, (-c, p)) AS p FROM w GROUP BY ALL)
        SELECT doc_id, item_id, c::INTEGER AS matched, len(s)::INTEGER AS size, c::DOUBLE / len(s) AS containment, p::INTEGER AS position
        FROM best JOIN items USING (k) WHERE c >= ceil(len(s) * 0.6 - 1e-9)""",
}
