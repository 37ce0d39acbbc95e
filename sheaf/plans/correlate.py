"""Correlation queries: documents as notes, benchmark items as what comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.catalog import query
from sheaf.functions import notes as N
from sheaf.functions import text as T
from sheaf.operators import correlate as C
from sheaf.operators import register as R
from sheaf.plans import graph, lens
from sheaf.tables import table

_STOP = ", ".join(f"'{w}'" for w in sorted(set(T.STOPWORDS)))


def _tok(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9][A-Za-z0-9''&.]{{2,}}'), lambda t: lower(trim(t, '.''&'))), lambda t: length(t) > 2 AND t NOT IN ({_STOP}) AND NOT regexp_full_match(t, '[0-9]+')))"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    return d.select(F.col("doc_id").alias("note"), F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("title"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("stem"), F.array("source").alias("codes"), none.alias("people"), F.array("lang").alias("tags"), F.coalesce("text", F.lit("")).alias("text"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("item"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("codes"), F.array().cast("array<string>").alias("participants"))


_W = f"""
    c AS (SELECT doc_id AS note, source, lang, substr(text, 1, 80) AS title FROM documents),
    it AS (SELECT item_id AS item, substr(text, 1, 60) AS title, text AS body FROM benchmark),
    p AS (SELECT DISTINCT note, unnest({_tok('title')}) AS key FROM c),
    w AS (SELECT key, count(*) AS df, round(ln((SELECT count(*) FROM c) / count(*)), 9)::DECIMAL(18, 9) AS idf FROM p GROUP BY key),
    q AS (SELECT DISTINCT item, unnest({_tok("title || ' ' || substr(body, 1, 2000)")}) AS key FROM it),
    tops AS (SELECT CASE WHEN max(idf) > 0 THEN max(idf)::DOUBLE ELSE 1 END AS top FROM w),
    tk AS (SELECT item, note, 'tokens' AS channel, least(25, round_even(25 * sum(idf)::DOUBLE / (any_value(top) * 2.5), 0))::INTEGER AS points, count(*)::VARCHAR AS reason
           FROM q JOIN w USING (key) JOIN p USING (key), tops WHERE idf > 0 GROUP BY item, note),
    tok AS (SELECT * FROM tk WHERE points >= 3),
    cod AS (SELECT item, note, 'code' AS channel, 40 AS points, upper(source) AS reason FROM it JOIN c ON source = 'src' || item % 20),
    ev AS (SELECT * FROM tok UNION ALL SELECT * FROM cod),
    sc AS (SELECT item, note, sum(points)::INTEGER AS score, max(points)::INTEGER AS best, array_to_string(list_sort(list_distinct(list(channel || ':' || reason)))[1:5], ',') AS evidence FROM ev GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, note) AS rank FROM sc)"""


def _sql(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([_W.strip(), *more]) + "\n" + select


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, c = items(spark, sf_dir), cards(spark, sf_dir)
    return C.tokens(i, c).unionByName(C.codes(i, c))


@query("corr_idf", _sql("SELECT key, df, idf::DOUBLE AS idf FROM w"))
def corr_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.idf(cards(spark, sf_dir)).withColumn("idf", F.col("idf").cast("double"))


@query("corr_tokens", _sql("SELECT * FROM tok"))
def corr_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tokens(items(spark, sf_dir), cards(spark, sf_dir))


@query("corr_codes", _sql("SELECT * FROM cod"))
def corr_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.codes(items(spark, sf_dir), cards(spark, sf_dir))


@query("corr_soft_codes", "SELECT item_id AS item, doc_id AS note, 'soft-code' AS channel, 28 AS points, 'DOC-' || doc_id AS reason FROM benchmark JOIN documents ON doc_id = item_id * 3")
def corr_soft_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = items(spark, sf_dir).withColumn("codes", F.array(F.concat(F.lit("doc "), (F.col("item") * 3).cast("string"))))
    return C.soft_codes(coded, cards(spark, sf_dir).withColumn("title", F.lit("")))


@query("corr_records", """WITH l AS (SELECT DISTINCT doc_id AS note, 'doc-' || (doc_id * 7 + 3) % 1500 AS k FROM documents WHERE doc_id % 5 <> 0
        UNION SELECT doc_id, 'doc-' || doc_id % 10 FROM documents WHERE doc_id % 3 = 0),
    x AS (SELECT item_id AS item, unnest(['doc-' || item_id, 'doc-' || item_id % 10]) AS k FROM benchmark),
    h AS (SELECT DISTINCT item, note, k FROM x JOIN l USING (k))
    SELECT item, note, 'record' AS channel, greatest(0, least(35, 45 - 35 * (row_number() OVER (PARTITION BY item, note ORDER BY k) - 1)))::INTEGER AS points, k AS reason FROM h""")
def corr_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lens.notes(spark, sf_dir).select(F.regexp_extract("path", r"doc-(\d+)\.md$", 1).cast("bigint").alias("note"), F.col("text"))
    i = items(spark, sf_dir).select("item", F.lit("about").alias("title"), F.concat(F.lit("see doc-"), F.col("item").cast("string"), F.lit(" and doc-"), (F.col("item") % 10).cast("string")).alias("body"))
    return C.records(i, n, r"doc-[0-9]+")


@query("corr_people", """SELECT o_orderkey AS item, c_custkey AS note, 'person' AS channel, 20 AS points, lower(c_name) AS reason FROM orders JOIN customer ON c_custkey = o_custkey""")
def corr_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.array(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("@example.com"))).alias("participants"))
    return C.people(i, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note"), F.array("c_name").alias("people")))


@query("corr_tags", """WITH t AS (SELECT DISTINCT doc_id AS note, lower(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+')[1]) AS k FROM documents),
    x AS (SELECT DISTINCT item_id AS item, unnest(regexp_split_to_array(lower(substr(text, 1, 60) || ' ' || text), '[^\\p{L}\\p{N}_]+')) AS k FROM benchmark)
    SELECT item, note, 'tag' AS channel, 10 AS points, k AS reason FROM x JOIN t USING (k) WHERE length(k) > 3""")
def corr_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = cards(spark, sf_dir).withColumn("tags", F.slice(F.split("text", r"[^\p{L}\p{N}_]+"), 1, 1))
    return C.tags(items(spark, sf_dir), tagged)


@query("corr_phrases", """WITH p AS (SELECT item_id AS note, lower(trim(split_part(text, '.', 1))) AS phrase FROM benchmark),
    m AS (SELECT DISTINCT doc_id AS item, phrase FROM documents JOIN p ON contains(lower(text), phrase) WHERE length(phrase) >= 6),
    k AS (SELECT * FROM m)
    SELECT item, note, 'phrase' AS channel, greatest(0, least(35, 40 - 35 * (row_number() OVER (PARTITION BY item, note ORDER BY length(phrase) DESC, phrase) - 1)))::INTEGER AS points, phrase AS reason FROM k JOIN p USING (phrase)""")
def corr_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("note"), F.split_part("text", F.lit("."), F.lit(1)).alias("title"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))
    return C.phrases(d, notes)


@query("corr_ranked", _sql("SELECT item, note, score, best, evidence, rank::INTEGER AS rank FROM rk WHERE rank <= 5"))
def corr_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ranked(_evidence(spark, sf_dir))


_KIN = """kin AS (SELECT a.item, a.note AS x, b.note AS y FROM rk a JOIN rk b ON a.item = b.item AND a.rank = 1 AND b.rank = 2 JOIN c d ON d.note = a.note JOIN c e ON e.note = b.note
           WHERE d.source = e.source OR d.lang = e.lang)"""


@query("corr_states", _sql("""SELECT it.item, f.note, coalesce(CASE WHEN f.score >= 70 AND f.best < 30 THEN 69 ELSE f.score END, 0)::INTEGER AS score,
    CASE WHEN f.score >= 40 AND f.best < 30 THEN 'weak'
         WHEN f.score >= 40 AND s.score IS NOT NULL AND f.score - s.score <= 15 AND kin.item IS NULL THEN 'ambiguous'
         WHEN f.score >= 70 THEN 'anchored' WHEN f.score >= 40 THEN 'correlated' ELSE 'topic-known' END AS state
    FROM it LEFT JOIN rk f ON f.item = it.item AND f.rank = 1 LEFT JOIN rk s ON s.item = it.item AND s.rank = 2 LEFT JOIN kin ON kin.item = it.item""", _KIN))
def corr_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = C.ranked(_evidence(spark, sf_dir))
    pair = top.where("rank = 1").select("item", F.col("note").alias("a")).join(top.where("rank = 2").select("item", F.col("note").alias("b")), "item").select("a", "b").distinct()
    return C.states(items(spark, sf_dir), top, C.related(cards(spark, sf_dir), pair))


@query("corr_inherited", """SELECT n_nationkey AS item, r_regionkey AS note, 'inherited' AS channel, 20 AS points, 'R' || r_regionkey AS reason FROM nation JOIN region ON r_regionkey = n_regionkey""")
def corr_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    code = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    climb = R.ancestors(n.select(code("N", "n_nationkey").alias("src"), F.lit("parent").alias("type"), code("R", "n_regionkey").alias("dst")))
    i = n.select(F.col("n_nationkey").alias("item"), F.array(code("N", "n_nationkey")).alias("codes"))
    return C.inherited(i, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("note"), F.array(code("R", "r_regionkey")).alias("codes")), climb)


@query("semantic_gaps", f"""WITH c AS (SELECT doc_id AS note, substr(text, 1, 80) AS title, coalesce(text, '') AS body, 'GRP-' || doc_id // 6 AS code FROM documents),
    p AS (SELECT DISTINCT note, unnest({_tok('title')}) AS key FROM c),
    q AS (SELECT DISTINCT note, unnest({_tok("coalesce(title, '') || ' ' || substr(body, 1, 2000)")}) AS key FROM c),
    w AS (SELECT key, round(ln((SELECT count(*) FROM c) / count(*)), 9)::DECIMAL(18, 9) AS idf FROM p GROUP BY key),
    tops AS (SELECT CASE WHEN max(idf) > 0 THEN max(idf)::DOUBLE ELSE 1 END AS top FROM w),
    k AS (SELECT a.note AS item, b.note FROM c a JOIN c b USING (code)),
    t AS (SELECT k.item, k.note, least(25, round_even(25 * sum(idf)::DOUBLE / (any_value(top) * 2.5), 0))::INTEGER AS points
          FROM k JOIN q ON q.note = k.item JOIN p ON p.note = k.note AND p.key = q.key JOIN w ON w.key = q.key, tops WHERE idf > 0 GROUP BY k.item, k.note),
    s AS (SELECT item, note, 40 + coalesce(CASE WHEN points >= 3 THEN points END, 0) AS score FROM k LEFT JOIN t USING (item, note)),
    f AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, note) AS r FROM s WHERE score >= 40),
    l AS (SELECT doc_id AS a, (doc_id * 7 + 3) % 1500 AS b FROM documents WHERE doc_id % 5 <> 0 UNION SELECT doc_id, doc_id % 10 FROM documents WHERE doc_id % 3 = 0),
    g AS (SELECT item, note, score FROM f WHERE r <= 20 AND item <> note AND NOT EXISTS (SELECT 1 FROM l WHERE (a = item AND b = note) OR (a = note AND b = item)))
    SELECT * FROM (SELECT item, note, score::INTEGER AS score, row_number() OVER (PARTITION BY item ORDER BY score DESC, note)::INTEGER AS rank FROM g) WHERE rank <= 5""")
def semantic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note is an item with its whole body.  Tokens give 25 points at most, and the floor is 40: only pairs with other evidence
    (here a code) can reach it, so tokens are compared for those alone."""
    c = cards(spark, sf_dir).withColumn("codes", F.array(F.concat(F.lit("GRP-"), F.floor(F.col("note") / 6).cast("string"))))
    i = c.select(F.col("note").alias("item"), "title", F.col("text").alias("body"), "codes")
    strong = C.codes(i, c)
    evidence = strong.unionByName(C.tokens(i, c, strong))
    number = lambda x: F.regexp_extract(x, r"doc-(\d+)\.md$", 1).cast("bigint")
    linked = graph.graph_resolved(spark, sf_dir).where("dst like '%.md'").select(number("src").alias("a"), number("dst").alias("b"))
    return C.gaps(evidence, linked)


@query("corr_links_out", lens.sql("SELECT src, string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM l GROUP BY src"))
def corr_links_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.links(lens.notes(spark, sf_dir)).groupBy("src").agg(F.array_join(F.slice(F.array_sort(F.collect_set("target")), 1, 200), ",").alias("targets"))
