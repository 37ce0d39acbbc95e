"""Personal data, denylist and ingest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.catalog import query
from sheaf.functions import text as T
from sheaf.operators import ingest as I
from sheaf.operators import leak as L
from sheaf.tables import table

TERMS = [("trash", "error"), ("disgusting", "note"), ("worthless", "note"), ('regex:token = "[^"]+"', "error")]
_RED = "CASE WHEN length(x) <= 4 THEN repeat('*', length(x)) ELSE left(x, 2) || repeat('*', least(length(x) - 4, 8)) || right(x, 2) END"
_FOLD = "translate(replace(replace(replace(replace(replace(replace(lower({0}), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), 'ø', 'o'), 'đ', 'd'), 'ł', 'l'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ‘’“”–—', 'aaaaaaceeeeiiiinooooouuuuyy''''\"\"--')"


def _pii(name: str, pattern: str, check: str = "true", blocking: str = "false") -> str:
    pattern = pattern.replace("'", "''")
    return f"""WITH h AS (SELECT doc_id, list_filter(regexp_extract_all(text, '{pattern}'), lambda x: {check}) AS hits FROM documents)
        SELECT doc_id, '{name}' AS class, len(hits)::INTEGER AS n, {blocking} AS blocking FROM h WHERE len(hits) > 0"""


def _scan(spark: SparkSession, sf_dir: str, *classes: str) -> DataFrame:
    return L.scan(table(spark, sf_dir, "documents"), "doc_id", "text", list(classes) or None)


@query("pii_email", _pii("email", L.EMAIL))
def pii_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "email").drop("samples")


_LUHN = r"""length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(regexp_replace(x, '[^0-9]', '', 'g')) + 1),
    lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(regexp_replace(x, '[^0-9]', '', 'g')), i, 1)::INTEGER ELSE (2 * substr(reverse(regexp_replace(x, '[^0-9]', '', 'g')), i, 1)::INTEGER) // 10 + (2 * substr(reverse(regexp_replace(x, '[^0-9]', '', 'g')), i, 1)::INTEGER) % 10 END)) % 10 = 0"""


@query("pii_card", _pii("card", L.CARD, _LUHN))
def pii_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "card").drop("samples")


@query("pii_credential", _pii("credential", L.CREDENTIAL, blocking="true"))
def pii_credential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, "credential").drop("samples")


@query("pii_blocking", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '%s') OR regexp_matches(text, '%s')" % (L.CREDENTIAL, L.KEY_BLOCK))
def pii_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, *L.BLOCKING).where("blocking").select("doc_id").distinct()


@query("pii_redacted", f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{L.EMAIL}'), lambda x: {_RED}), ',') AS redacted FROM documents WHERE regexp_matches(text, '{L.EMAIL}')")
def pii_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.matches(F.col("text"), L.EMAIL).alias("hits")).where("size(hits) > 0")
    return d.select("doc_id", F.array_join(F.transform("hits", lambda x: T.redact(x)), ",").alias("redacted"))


@query("pii_scan")
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir)


@query("pii_conversations", f"SELECT conv_id, turn, len(regexp_extract_all(text, '{L.EMAIL}'))::INTEGER AS n FROM conversations WHERE regexp_matches(text, '{L.EMAIL}')")
def pii_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.matches(F.col("text"), L.EMAIL)).alias("n"))
    return c.where("n > 0")


_UNITS = f"""u AS (SELECT 'doc-' || doc_id AS unit, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS row, generate_subscripts(string_split(rtrim(text, chr(10)), chr(10)), 1) AS line FROM documents),
    g AS (SELECT unit, line, {_FOLD.format('row')} AS folded FROM u),
    h AS (SELECT unit, line, 'trash' AS term, 'error' AS severity, 'trash' AS hit FROM g WHERE regexp_matches(folded, '\\btrash\\b')
          UNION ALL SELECT unit, line, 'disgusting', 'note', 'disgusting' FROM g WHERE regexp_matches(folded, '\\bdisgusting\\b')
          UNION ALL SELECT unit, line, 'worthless', 'note', 'worthless' FROM g WHERE regexp_matches(folded, '\\bworthless\\b')
          UNION ALL SELECT unit, line, 'regex:token = "[^"]+"', 'error', regexp_extract(folded, 'token = "[^"]+"') FROM g WHERE regexp_matches(folded, 'token = "[^"]+"')),
    e AS (SELECT unit, line::INTEGER AS line, term, severity, hit, substr(sha256(unit || '|' || hit), 1, 16) AS fingerprint, row_number() OVER (PARTITION BY unit ORDER BY line, term)::INTEGER AS rank FROM h)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("unit"), "text")


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "term string, severity string")


@query("egress_findings", f"WITH {_UNITS} SELECT * FROM e WHERE rank <= 21")
def egress_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.denied(units(spark, sf_dir), _terms(spark))


@query("egress_capped", f"WITH {_UNITS} SELECT unit, count(*) FILTER (rank <= 2) AS listed, count(*) FILTER (rank > 2) > 0 AS more FROM e WHERE rank <= 3 GROUP BY unit")
def egress_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.denied(units(spark, sf_dir), _terms(spark), cap=2).groupBy("unit").agg(F.count_if(F.col("rank") <= 2).alias("listed"), (F.count_if(F.col("rank") > 2) > 0).alias("more"))


@query("egress_hashed", f"WITH {_UNITS}, t AS (SELECT DISTINCT unit, line, unnest(regexp_extract_all(folded, '[a-z0-9]+')) AS token FROM g) SELECT unit, line::INTEGER AS line, sha256(token) AS digest FROM t WHERE token IN ('trash', 'worthless', 'mit')")
def egress_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.createDataFrame([("trash",), ("worthless",), ("mit",)], "t string").select(F.sha2("t", 256).alias("digest"))
    return L.hashed(units(spark, sf_dir), h)


@query("egress_emit_hashes", "SELECT DISTINCT sha256(lower(replace(n_name, '_', ''))) AS digest FROM nation WHERE lower(n_name) <> 'nation_3'")
def egress_emit_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.hash_terms(table(spark, sf_dir, "nation").select(F.translate("n_name", "_", "").alias("term")), ["nation3"])


@query("denylist_variants", "SELECT n_name AS term, unnest([array_to_string(string_split(n_name, ''), '-'), array_to_string(string_split(n_name, ''), ' ')]) AS variant FROM nation")
def denylist_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unlisted_variants(table(spark, sf_dir, "nation").select(F.col("n_name").alias("term")))


@query("denylist_families", "SELECT r_name AS parent, count(*) FILTER (n_nationkey % 3 = 0) AS n_listed, count(*) FILTER (n_nationkey % 3 <> 0) AS n_unlisted FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name HAVING n_listed > 0 AND n_unlisted > 0")
def denylist_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    members = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("parent"), F.col("n_name").alias("name"))
    return L.families(members, n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("term")))


@query("denylist_liveness", "SELECT n_name AS term, CASE WHEN n_nationkey % 3 = 0 THEN 'live' WHEN n_nationkey % 3 = 1 THEN 'dead' ELSE 'untested' END AS state FROM nation")
def denylist_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return L.liveness(n.select(F.col("n_name").alias("term"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("in "), F.lower("n_name"))).when(F.col("n_nationkey") % 3 == 1, "elsewhere").alias("example")))


def _conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("ingest_content_hash", "SELECT conv_id, turn, substr(sha256(role || chr(0) || text), 1, 16) AS hash FROM conversations")
def ingest_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conv(spark, sf_dir).select("conv_id", "turn", T.content_hash(F.col("role"), F.col("text")).alias("hash"))


@query("ingest_band", "SELECT CASE WHEN s >= 60 THEN 'ACT-NOW' WHEN s >= 40 THEN 'REVIEW' WHEN s >= 20 THEN 'SCAN' ELSE 'FYI' END AS band, count(*) AS n FROM (SELECT length(text) % 100 AS s FROM conversations) GROUP BY ALL")
def ingest_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conv(spark, sf_dir).groupBy(T.band(F.length("text") % 100).alias("band")).agg(F.count("*").alias("n"))


@query("ingest_questions", r"SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '(?m)^[^\n]{10,220}\?\s*$')[1:5], lambda q: regexp_replace(q, '^\s+|\s+$', '', 'g')), ' // ') AS questions FROM conversations WHERE regexp_matches(text, '(?m)^[^\n]{10,220}\?\s*$')")
def ingest_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conv(spark, sf_dir).select("conv_id", "turn", I.questions(F.col("text")).alias("q")).where("size(q) > 0").select("conv_id", "turn", F.array_join("q", " // ").alias("questions"))


@query("ingest_first_lines", r"SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '[A-Za-z0-9]'))[1:3], lambda x: substr(x, 1, 120)), ' / ') AS head FROM conversations")
def ingest_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conv(spark, sf_dir).select("conv_id", "turn", I.first_lines(F.col("text")).alias("head"))


_ESC = """WITH s AS (SELECT conv_id, turn, length(text) AS len, length(text) % 100 AS score, turn % 2 AS topics, conv_id % 2 AS actions, conv_id % 5 AS questions, conv_id % 3 AS attachments, turn % 3 AS parsed, conv_id % 7 = 0 AS aside, conv_id % 4 = 0 AS isnew, conv_id % 6 AS grp FROM conversations),
    a AS (SELECT conv_id, turn, greatest(0, least(100,
        CASE WHEN topics = 0 AND score >= 40 THEN 20 ELSE 0 END + CASE WHEN actions > 0 AND questions = 0 THEN 15 ELSE 0 END
        + CASE WHEN questions >= 3 THEN 15 ELSE 0 END + CASE WHEN conv_id % 9 = 0 THEN 15 ELSE 0 END + CASE WHEN len > 3000 THEN 15 ELSE 0 END
        + CASE WHEN len < 400 AND attachments > 0 THEN 15 ELSE 0 END + CASE WHEN conv_id % 8 = 0 THEN 20 ELSE 0 END
        + CASE WHEN attachments = 2 AND parsed = 0 THEN 15 ELSE 0 END + CASE WHEN score >= 50 AND aside THEN 10 ELSE 0 END
        + CASE WHEN isnew AND score >= 40 THEN 10 ELSE 0 END + CASE WHEN grp >= 4 THEN 10 ELSE 0 END
        + CASE WHEN len < 800 AND topics > 0 AND score < 40 AND NOT (attachments > 0 AND parsed = 0) THEN -15 ELSE 0 END))::INTEGER AS ambiguity FROM s)
    SELECT conv_id, turn, ambiguity, (100 - ambiguity)::INTEGER AS confidence, ambiguity >= 35 AS escalate FROM a"""


@query("ingest_escalation", _ESC)
def ingest_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    s = _conv(spark, sf_dir).select(
        "conv_id", "turn", F.length("text").alias("body_len"), (t % 2).alias("n_topics"), (F.length("text") % 100).alias("score"), (c % 2).alias("n_actions"), (c % 5).alias("n_questions"), F.lit(0).alias("n_deadlines"),
        F.when(c % 9 == 0, "unresolved").alias("deadline_state"), (c % 3).alias("n_attachments"), F.when(c % 3 == 2, 1).otherwise(0).alias("n_delegating"), (t % 3).alias("n_parsed"), F.when(c % 8 == 0, 1).otherwise(0).alias("n_vision"),
        (c % 7 == 0).alias("aside"), (c % 4 == 0).alias("is_new"), (c % 6).alias("group_size"),
    )
    e = I.escalation(s)
    return e.select("conv_id", "turn", "ambiguity", "confidence", (F.col("ambiguity") >= I.THRESHOLD).alias("escalate"))


@query("item_envelope", "SELECT item_id AS item, CASE WHEN item_id % 4 = 0 THEN 'untitled' ELSE 'item ' || item_id END AS title, substr(text, 1, 8000) AS body, array_to_string(list_sort(list_distinct(['B' || item_id % 5, 'A'])), ',') AS codes, '2024-01-02' AS date FROM benchmark")
def item_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    raw = b.select(i.alias("item"), F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("item "), i.cast("string"))).alias("title"), F.col("text").alias("body"), F.lit(None).cast("array<string>").alias("participants"), F.array(F.concat(F.lit("B"), (i % 5).cast("string"))).alias("codes"), F.array(F.lit("A")).alias("topics"), F.lit("2024-01-02").cast("date").alias("date"))
    return I.envelope(raw).select("item", "title", "body", F.array_join("codes", ",").alias("codes"), "date")
