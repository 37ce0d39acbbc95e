"""Tag, front matter, inventory, naming and register queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.catalog import query
from sheaf.functions import notes as N
from sheaf.functions import text as T
from sheaf.operators import frontmatter as FM
from sheaf.operators import register as R
from sheaf.operators import tags as TG
from sheaf.plans import lens
from sheaf.tables import table

_TAGS = "tg AS (SELECT path, lang AS tag, 'fm' AS origin FROM n UNION ALL SELECT path, ['data-set', 'data_sets', 'Data-Set', 'dataset'][i % 4 + 1], 'fm' FROM n UNION ALL SELECT path, 'tag-' || i % 4, 'inline' FROM n), tc AS (SELECT tag, count(DISTINCT path) AS n_notes FROM tg GROUP BY tag)"


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.tags(lens.notes(spark, sf_dir))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.fields(lens.notes(spark, sf_dir))


@query("tag_counts", lens.sql("SELECT tag, n_notes FROM tc", _TAGS))
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.counts(_tags(spark, sf_dir))


@query("tag_proposals", lens.sql("SELECT 'dataset' AS norm, 'data-set' AS canonical, tag AS variant, n_notes FROM tc WHERE tag IN ('data_sets', 'Data-Set', 'dataset')", _TAGS))
def tag_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.proposals(tag_counts(spark, sf_dir))


@query("tag_rewrites", lens.sql("SELECT path, tag AS old, 'data-set' AS new FROM tg WHERE tag IN ('data_sets', 'Data-Set', 'dataset')", _TAGS))
def tag_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _tags(spark, sf_dir)
    return TG.rewrites(tags, TG.proposals(TG.counts(tags)))


@query("tag_near_duplicates", lens.sql("""SELECT norm, count(*) AS n_variants, string_agg(tag, ',' ORDER BY tag) AS variants, sum(uses)::BIGINT AS uses
    FROM (SELECT CASE WHEN x LIKE '%s' THEN left(x, length(x) - 1) ELSE x END AS norm, tag, uses
          FROM (SELECT tag, translate(lower(tag), '_-/', '') AS x, count(*) AS uses FROM tg GROUP BY tag)) GROUP BY norm HAVING count(*) > 1""", _TAGS))
def tag_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TG.near_duplicates(_tags(spark, sf_dir))


@query("tag_distinct", lens.sql("SELECT origin, count(DISTINCT tag) AS n_tags, count(*) AS uses FROM tg GROUP BY origin", _TAGS))
def tag_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).groupBy("origin").agg(F.countDistinct("tag").alias("n_tags"), F.count("*").alias("uses"))


@query("inv_top_dirs", "SELECT source AS dir, count(*) AS n_notes FROM documents GROUP BY source")
def inv_top_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.notes(spark, sf_dir).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).agg(F.count("*").alias("n_notes"))


@query("inv_name_stats", "SELECT count(*) AS total, round(avg(length('doc-' || doc_id)), 6) AS avg_length, max(length('doc-' || doc_id))::INTEGER AS max_length, 0::BIGINT AS with_dashes, 0::BIGINT AS with_parenthesis FROM documents")
def inv_name_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    return lens.notes(spark, sf_dir).select(stem.alias("stem")).agg(
        F.count("*").alias("total"), F.round(F.avg(F.length("stem")), 6).alias("avg_length"), F.max(F.length("stem")).alias("max_length"),
        F.count_if(F.col("stem").contains(" -- ") | F.col("stem").rlike("[—–]")).alias("with_dashes"), F.count_if(F.col("stem").rlike(r"\(.+\)")).alias("with_parenthesis"),
    )


@query("inv_field_frequency", lens.sql("SELECT field, count(*) AS n FROM (SELECT field FROM f UNION ALL SELECT 'tags' FROM n UNION ALL SELECT 'system' FROM n WHERE i % 6 = 5) GROUP BY field", lens.fields_sql()))
def inv_field_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n"))


@query("inv_values", lens.sql("SELECT field, value, count(*) AS n FROM f WHERE field IN ('status', 'lang', 'note_type') GROUP BY ALL", lens.fields_sql()))
def inv_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir).where("field in ('status', 'lang', 'note_type')")
    return f.select("field", F.explode(N.values(F.col("value"))).alias("value")).groupBy("field", "value").agg(F.count("*").alias("n"))


@query("inv_longest_names", "SELECT source || '/doc-' || doc_id || '.md' AS path, length('doc-' || doc_id)::INTEGER AS length FROM documents ORDER BY length DESC, path LIMIT 10")
def inv_longest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lens.notes(spark, sf_dir).select("path", F.length(F.regexp_extract("path", r"([^/]*)\.md$", 1)).alias("length"))
    return n.orderBy(F.desc("length"), "path").limit(10)


VOCAB = [("status", "active"), ("status", "done"), ("status", "open"), ("lang", "en"), ("lang", "fr"), ("note_type", "note"), ("note_type", "spec")]
_OFF = "off AS (SELECT path, field, value FROM f WHERE (field = 'status' AND value = 'Draft') OR (field = 'lang' AND value NOT IN ('en', 'fr')) OR (field = 'note_type' AND value = 'misc'))"


def _off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FM.off_vocabulary(_fields(spark, sf_dir), spark.createDataFrame(VOCAB, "field string, value string"), ["queued"])


@query("fm_offvocab", lens.sql("SELECT path, field, value FROM off", lens.fields_sql(), _OFF))
def fm_offvocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _off(spark, sf_dir)


@query("fm_lint_counts", lens.sql("SELECT field, value, count(*) AS n, min(path) AS first_path FROM off GROUP BY ALL", lens.fields_sql(), _OFF))
def fm_lint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _off(spark, sf_dir).groupBy("field", "value").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query("fm_missing", lens.sql("SELECT path FROM n WHERE i % 5 = 0"))
def fm_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = lens.notes(spark, sf_dir)
    return FM.missing(notes, N.fields(notes), "note_type")


@query("fm_unknown", lens.sql("SELECT path, 'owner' AS field FROM n WHERE i % 7 = 0"))
def fm_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FM.unknown(_fields(spark, sf_dir), "lang tags status note_type date created system".split())


@query("fm_states", lens.sql("SELECT 'ok' AS state, count(*) AS n FROM n"))
def fm_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.parsed(lens.notes(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"))


@query("fm_status_fix", lens.sql("SELECT path, 'Draft' AS old, 'draft' AS new FROM n WHERE i % 4 = 2 UNION ALL SELECT path, 'open', 'active' FROM n WHERE i % 4 = 3"))
def fm_status_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FM.remap(_fields(spark, sf_dir), "status", {"Draft": "draft", "open": "active", "done": "done"})


@query("fm_date_fix", lens.sql("SELECT path, CASE WHEN i % 4 = 0 THEN 'drop' ELSE 'rename' END AS action FROM n WHERE i % 4 = 0 OR i % 2 = 1"))
def fm_date_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FM.date_fix(_fields(spark, sf_dir))


@query("note_type_derive", lens.sql("SELECT path, CASE WHEN path LIKE '%doc-1%' THEN 'spec' WHEN source = 'src1' THEN 'daily' WHEN source = 'src2' THEN 'source' END AS note_type FROM n WHERE i % 5 = 0"))
def note_type_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_missing(spark, sf_dir).select("path", FM.derived_type(F.col("path"), [("src1", "daily"), ("src2", "source")], [("doc-1", "spec")]).alias("note_type"))


@query("schema_infer", lens.sql("""SELECT field, n_uses, n_values, CASE WHEN n_values <= 24 THEN 'enum' ELSE 'open' END AS kind, CASE WHEN n_values <= 24 THEN vocabulary END AS vocabulary
    FROM (SELECT field, sum(c)::BIGINT AS n_uses, count(*) AS n_values, string_agg(value, ',' ORDER BY value) AS vocabulary
          FROM (SELECT field, value, count(*) AS c FROM (SELECT field, value FROM f UNION ALL SELECT 'tags', tag FROM tg WHERE origin = 'fm') GROUP BY ALL) GROUP BY field)""", lens.fields_sql(), _TAGS))
def schema_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FM.infer(_fields(spark, sf_dir))


@query("title_proposals", "SELECT p_partkey, replace(p_name, ' ', ' -- ') AS stem, regexp_replace(replace(p_name, ' ', ', '), ', ', ': ') AS title FROM part")
def title_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(" -- ")).alias("stem"))
    return p.withColumn("title", T.title_from_name(F.col("stem")))


@query("name_kebab", "SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name || ' ' || p_type || ' X' || p_partkey, '[ _/-]+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_full_match(w, '[A-Z0-9]{2,}') THEN w ELSE lower(w) END), '-') AS kebab FROM part")
def name_kebab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.kebab(F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("X"), F.col("p_partkey").cast("string")))).alias("kebab"))


@query("name_collisions", "SELECT lower(p_brand) AS new, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("new")).agg(F.count("*").alias("n")).where("n > 1")


def _register(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    entities = [(f"SYS-{k}", "system") for k in range(10)] + [(f"ORG-{k}", "org") for k in range(3)]
    return spark.createDataFrame(entities, "id string, tier string"), spark.createDataFrame([(f"sys {k}", f"SYS-{k}") for k in range(10)], "alias string, id string"), spark.createDataFrame(lens.REGISTER_TIERS, "tier string, field string")


@query("reg_conformance", lens.sql("""SELECT path, 'system' AS field, value,
    ['alias', 'compound', 'unknown', 'wrong-category'][i % 6] AS state, CASE i % 6 WHEN 1 THEN 'SYS-' || i % 10 WHEN 2 THEN 'SYS-1+SYS-2' WHEN 4 THEN value END AS canonical
    FROM f WHERE field = 'system' AND i % 6 IN (1, 2, 3, 4)""", lens.fields_sql()))
def reg_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conformance(_fields(spark, sf_dir), *_register(spark))


@query("reg_states", lens.sql("SELECT ['alias', 'compound', 'unknown', 'wrong-category'][i % 6] AS state, count(*) AS n FROM f WHERE field = 'system' AND i % 6 IN (1, 2, 3, 4) GROUP BY ALL", lens.fields_sql()))
def reg_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg_conformance(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query("reg_ancestors", """WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst FROM nation UNION ALL SELECT 'R' || r_regionkey, 'R' || (r_regionkey + 1) % 5 FROM region),
    a AS (SELECT src AS id, dst AS ancestor, 1 AS depth, [src, dst] AS seen FROM e
          UNION ALL SELECT id, dst, depth + 1, list_append(seen, dst) FROM a JOIN e ON ancestor = src WHERE NOT list_contains(seen, dst))
    SELECT id, ancestor, depth FROM a""")
def reg_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    code = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = n.select(code("N", F.col("n_nationkey")).alias("src"), code("R", F.col("n_regionkey")).alias("dst")).unionByName(r.select(code("R", F.col("r_regionkey")).alias("src"), code("R", (F.col("r_regionkey") + 1) % 5).alias("dst")))
    return R.ancestors(e.withColumn("type", F.lit("parent")))
