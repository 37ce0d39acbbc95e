"""Changes to note texts, as rows to review; ``sheaf.sources.files.publish`` writes them."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import notes as N
from sheaf.functions import text as T

_MARK = "\x01"


def links(notes: DataFrame, renames: DataFrame) -> DataFrame:
    """(path, old, new): texts of notes whose wikilinks name a renamed stem (stem, new_stem).  Anchors, aliases and folders stay
    as they are.  A note gets only the renames that it has links to; all are applied at once, so that one rename can't feed
    another, and longer names go first."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split("target", "/"), -1), r"\.md$", ""))
    used = N.links(notes).select(F.col("src").alias("path"), stem.alias("key")).distinct()
    mine = used.join(renames.select(F.lower("stem").alias("key"), "stem", "new_stem"), "key").groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.length("stem")).alias("n"), "stem", "new_stem"))).alias("renames"))

    def one(text: Column, r: Column) -> Column:
        pattern = F.concat(F.lit(r"(?i)(\[\[(?:[^\[\]|#]*/)?)\Q"), r["stem"], F.lit(r"\E(?=(?:\.md)?[\]|#\\])"))
        return F.regexp_replace(text, pattern, F.concat(F.lit("$1" + _MARK), F.regexp_replace(r["new_stem"], r"([\\$])", r"\\$1")))

    new = F.replace(F.aggregate("renames", F.col("text"), one), F.lit(_MARK), F.lit(""))
    return notes.join(mine, "path").select("path", F.col("text").alias("old"), new.alias("new")).where("old <> new")


def scalar(value: Column) -> Column:
    """A value as YAML: quoted where it would be read as something else."""
    plain = value.rlike(r"^[A-Za-z][\w ./-]*$") & ~F.lower(value).isin("true", "false", "yes", "no", "on", "off", "null", "y", "n") & ~value.rlike(r"\s$")
    return F.when(plain, value).otherwise(F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def front_matter(fields: dict[str, Column], lists: dict[str, Column]) -> Column:
    """A front matter block; empty scalars and lists are left out, order is as given."""
    rows = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), scalar(v))) for k, v in fields.items()]
    rows += [F.when(F.size(v) > 0, F.concat(F.lit(f"{k}: ["), F.array_join(F.transform(v, scalar), ", "), F.lit("]"))) for k, v in lists.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.filter(F.array(*rows), lambda r: r.isNotNull()), "\n"), F.lit("\n---\n"))


def _slugs(titles: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return re.sub(r"[\W_]+", "-", plain).strip("-").lower()[:60].rstrip("-")

    return titles.map(one)


def slug(title: Column) -> Column:
    """Lower case, without marks, hyphens between words, at most sixty characters.  (Spark has no NFKD, hence Python.)"""
    return F.pandas_udf(_slugs, "string")(title)


def guard(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings (path, line, ...) of changed files with ``introduced``: whether their line was touched.  Changes are (path, line);
    a null line says that the whole file counts as touched.  Findings in other files aren't listed."""
    lines = changes.where("line is not null").select("path", "line").distinct().withColumn("hit", F.lit(True))
    whole = changes.where("line is null").select("path").distinct().withColumn("all", F.lit(True))
    there = findings.join(changes.select("path").distinct(), "path", "left_semi")
    return there.join(lines, ["path", "line"], "left").join(whole, "path", "left").withColumn("introduced", F.coalesce("hit", "all", F.lit(False))).drop("hit", "all")


def inbound(notes: DataFrame) -> DataFrame:
    """(path, refs): by how many other notes each is named, as ``[[stem]]`` or ``(name.md)``.  References are taken from every
    text once, and counted."""
    name = F.element_at(F.split("path", "/"), -1)
    wiki = N.links(notes).select("src", F.element_at(F.split("target", "/"), -1).alias("t")).select("src", F.concat(F.regexp_replace("t", r"\.md$", ""), F.lit(".md")).alias("name"))
    paren = notes.select(F.col("path").alias("src"), F.explode(T.matches(F.col("text"), r"\((?:[A-Za-z0-9_][\w.-]*/)*([A-Za-z0-9_][\w.-]*\.md)\)", 1)).alias("name"))
    refs = wiki.unionByName(paren).distinct()
    named = notes.select("path", name.alias("name"))
    found = refs.join(named, "name").where("src <> path").groupBy("path").agg(F.count("*").alias("refs"))
    return named.select("path").join(found, "path", "left").select("path", F.coalesce("refs", F.lit(0)).alias("refs"))


def index_lint(index: DataFrame, most: int = 260) -> DataFrame:
    """(line, rule) of index entries (line, text) that are too long, or use dashes or arrows outside of links and code."""
    bare = reduce(lambda c, p: F.regexp_replace(c, p, ""), (r"\[\[[^\]]*\]\]", r"\[[^\]]*\]\([^)]*\)", "`[^`]*`"), F.col("text"))
    rules = F.array(F.when(bare.rlike(r"\s[—–]\s|\s--\s"), "dash"), F.when(bare.rlike("->|→|=>"), "arrow"), F.when(F.length("text") > most, "long"))
    return index.where(F.col("text").rlike(r"^\s*[-*]\s")).select("line", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def snoozed(reviewed: Column, ttl: Column, now: str, usual: int = 120) -> Column:
    """Whether a note was reviewed within its time to live (days)."""
    return F.coalesce(F.datediff(F.lit(now).cast("date"), F.try_to_date(T.day(reviewed))) <= F.coalesce(F.try_to_number(ttl, F.lit("99999")).cast("int"), F.lit(usual)), F.lit(False))


def deadline(phrase: Column, base: Column) -> Column:
    """The day that a phrase names, seen from a day: an ISO date, today, tomorrow, or in so many days or weeks; null if none."""
    n = F.regexp_extract(phrase, r"(?i)\bin\s+(\d{1,4})\s+(day|week)s?\b", 1)
    unit = F.when(F.lower(F.regexp_extract(phrase, r"(?i)\bin\s+(\d{1,4})\s+(day|week)s?\b", 2)) == "week", 7).otherwise(1)
    iso = F.regexp_extract(phrase, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    return F.when(iso != "", F.try_to_date(iso)).when(phrase.rlike(r"(?i)\btoday\b"), base).when(phrase.rlike(r"(?i)\btomorrow\b"), F.date_add(base, 1)).when(n != "", F.date_add(base, n.cast("int") * unit))


def pins(docs: DataFrame, name: str) -> DataFrame:
    """(path, line, version) of versions of ``name`` that texts tell readers to copy, the first of each line."""
    p = rf"\b{name}(?:@|==|/|\s+)v?(\d+\.\d+(?:\.\d+)?)\b"
    rows = docs.select("path", F.posexplode(T.lines(F.col("text"))).alias("pos", "row"))
    return rows.where(F.col("row").rlike(p)).select("path", (F.col("pos") + 1).alias("line"), F.regexp_extract("row", p, 1).alias("version"))
