"""Personal data, secrets and denied terms in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text as T

EMAIL = r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]{2,}\b"
PHONE = r"(?<![\w/.\-:])(?:\+\d{1,3}[\s.\-]?\(?0?\)?[\s.\-]?\d[\d\s.\-]{6,14}\d|\b0\d{1,3}[\s.\-/]\d{2,3}[\s.\-]?\d{2}[\s.\-]?\d{2}\b)(?![\w/\-:])"
IBAN = r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9][ ]?){10,30}\b"
CARD = r"\b(?:[0-9][ -]?){13,19}\b"
CREDENTIAL = r"(?i)\b(?:pass(?:word|wd)|wachtwoord|mot\s*de\s*passe|api[_-]?key|secret|token|private[_-]?key)\b\s*[:=]\s*\S{4,}"
KEY_BLOCK = "-----BEGIN (?:RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----"
BLOCKING = ("credential", "private_key_block")
SAMPLES = 5


def found(text: Column) -> dict[str, Column]:
    """For each class of personal data or secrets the array of what passes its pattern and its check."""
    return {
        "email": T.matches(text, EMAIL),
        "phone": T.matches(text, PHONE),
        "iban": F.filter(T.matches(text, IBAN), lambda x: T.iban(x)),
        "card": F.filter(T.matches(text, CARD), lambda x: T.luhn(x)),
        "credential": T.matches(text, CREDENTIAL),
        "private_key_block": T.matches(text, KEY_BLOCK),
    }


def scan(docs: DataFrame, key: str, text: str, classes: list[str] | None = None) -> DataFrame:
    """(key, class, n, samples, blocking): hits of each class, at most five different ones shown, redacted."""
    each = {c: x for c, x in found(F.col(text)).items() if classes is None or c in classes}
    rows = docs.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("class"), x.alias("hits")) for c, x in each.items()])).alias("f")).where("size(f.hits) > 0")
    shown = F.slice(F.array_distinct(F.transform("f.hits", lambda x: T.redact(x))), 1, SAMPLES)
    return rows.select(key, "f.class", F.size("f.hits").alias("n"), F.array_join(shown, ",").alias("samples"), F.col("f.class").isin(*BLOCKING).alias("blocking"))


def pattern(term: str) -> str:
    """The pattern of a denied term: itself after ``regex:``, else its words, bounded where they begin or end in a letter."""
    if term.startswith("regex:"):
        return term[6:].strip()
    import re

    body = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", term)
    return (r"\b" if term[:1].isalnum() else "") + body + (r"\b" if term[-1:].isalnum() else "")


def denied(units: DataFrame, terms: DataFrame, cap: int = 20, baseline: DataFrame | None = None) -> DataFrame:
    """(unit, line, term, severity, hit, fingerprint, rank) of lines of units (unit, text) with a term (term, severity); of a
    unit's findings ``cap`` are listed, and rank ``cap`` + 1 says that there are more.  The term list is small (it is written by
    hand) and becomes part of the plan."""
    listed = terms.select("term", "severity").collect()
    rows = units.select("unit", F.posexplode(T.lines(F.col("text"))).alias("pos", "row")).withColumn("folded", T.fold(F.col("row")))
    hits = F.filter(F.array(*[F.when(F.col("folded").rlike("(?i)" + pattern(t.term)), F.struct(F.lit(t.term).alias("term"), F.lit(t.severity).alias("severity"), F.regexp_substr("folded", F.lit("(?i)" + pattern(t.term))).alias("hit"))) for t in listed]), lambda x: x.isNotNull())
    found_ = rows.select("unit", (F.col("pos") + 1).alias("line"), F.explode(hits).alias("h")).select("unit", "line", "h.*")
    found_ = found_.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("|", F.regexp_replace("unit", "^[0-9a-f]{7,40}:", ""), "hit"), 256), 1, 16))
    if baseline is not None:
        found_ = found_.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return found_.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy("line", "term"))).where(F.col("rank") <= cap + 1)


def hashed(units: DataFrame, hashes: DataFrame) -> DataFrame:
    """(unit, line, digest) of lines with a token whose SHA-256 is in ``hashes`` (digest); the token isn't shown."""
    rows = units.select("unit", F.posexplode(T.lines(F.col("text"))).alias("pos", "row"))
    each = rows.select("unit", (F.col("pos") + 1).alias("line"), F.explode(F.array_distinct(T.matches(T.fold(F.col("row")), "[a-z0-9]+"))).alias("token"))
    return each.withColumn("digest", F.sha2("token", 256)).join(hashes.select("digest").distinct(), "digest", "left_semi").select("unit", "line", "digest")


def hash_terms(terms: DataFrame, common: list[str]) -> DataFrame:
    """(digest) of single-token terms of at least four characters that aren't common words."""
    t = T.fold(F.btrim("term"))
    return terms.select(t.alias("t")).where(F.col("t").rlike("^[a-z0-9]{4,}$") & ~F.col("t").isin(common)).select(F.sha2("t", 256).alias("digest")).distinct()


def variants(term: Column) -> Column:
    """Spellings of a term that a denylist may lack."""
    chars = T.chars(term)
    return F.array_distinct(F.array(term, F.upper(term), F.lower(term), F.initcap(term), F.array_join(chars, "-"), F.array_join(chars, " ")))


def unlisted_variants(terms: DataFrame) -> DataFrame:
    """(term, variant) of variants that no term of the list matches, fold and case aside."""
    listed = [pattern(r.term) for r in terms.select("term").collect()]
    v = terms.select("term", F.explode(variants(F.col("term"))).alias("variant"))
    hit = reduce(lambda x, y: x | y, [T.fold(F.col("variant")).rlike("(?i)" + p) for p in listed]) if listed else F.lit(False)
    return v.where(~hit)


def liveness(terms: DataFrame) -> DataFrame:
    """(term, state) of annotated terms (term, example): dead where the term doesn't match its own example, untested without."""
    rows = terms.select("term", "example").collect()
    if not rows:
        return terms.select("term", F.lit("untested").alias("state"))
    alive = F.lit(None).cast("boolean")
    for r in rows:
        alive = F.when(F.col("term") == r.term, F.col("example").rlike("(?i)" + pattern(r.term))).otherwise(alive)
    return terms.select("term", F.when(F.col("example").isNull(), "untested").when(alive, "live").otherwise("dead").alias("state"))


def families(members: DataFrame, terms: DataFrame) -> DataFrame:
    """(parent, n_listed, n_unlisted) of register families (parent, name) that the list covers only in part."""
    listed = [pattern(r.term) for r in terms.select("term").collect()]
    hit = reduce(lambda x, y: x | y, [T.fold(F.col("name")).rlike("(?i)" + p) for p in listed]) if listed else F.lit(False)
    g = members.groupBy("parent").agg(F.count_if(hit).alias("n_listed"), F.count_if(~hit).alias("n_unlisted"))
    return g.where("n_listed > 0 and n_unlisted > 0")
