"""Parsing of notes: front matter, links, headings, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text as T

WIKILINK, MDLINK = r"(!?)\[\[([^\[\]]+?)\]\]", r"!?\[[^\]]*\]\(([^)]+)\)"
HEADING, BLOCK = r"^\s{0,3}#{1,6}\s+(.*\S)", r"\s\^([A-Za-z0-9][\w-]*)\s*$"
#: Front matter longer than this counts as an error.
MOST_BYTES = 64 * 1024


def split(text: Column) -> tuple[Column, Column, Column]:
    """(state, block, body) of a note: state absent, error or ok; the body has no front matter."""
    end = F.locate("\n---", text, 4)
    has = text.startswith("---") & (end > 0)
    block = F.when(has, F.substring(text, F.lit(4), end - 4))
    body = F.when(has, F.substring(text, end + 4, F.length(text))).otherwise(text)
    state = F.when(~has, "absent").when(F.octet_length(block) > MOST_BYTES, "error").otherwise("ok")
    return state, block, body


def parsed(notes: DataFrame) -> DataFrame:
    """(path, state, block, body) of notes (path, text)."""
    state, block, body = split(F.col("text"))
    return notes.select("path", state.alias("state"), block.alias("block"), body.alias("body"))


def fields(notes: DataFrame) -> DataFrame:
    """(path, field, value, line) of top-level ``key: value`` lines of the front matter; the line after the fence is line 2."""
    p = parsed(notes).where("state = 'ok'")
    rows = p.select("path", F.posexplode(F.split("block", "\n")).alias("pos", "row"))
    return rows.select("path", F.regexp_extract("row", r"^([A-Za-z_][\w-]*):\s*(\S.*?)\s*$", 1).alias("field"), F.regexp_extract("row", r"^([A-Za-z_][\w-]*):\s*(\S.*?)\s*$", 2).alias("value"), (F.col("pos") + 1).alias("line")).where("field <> ''")


def values(value: Column) -> Column:
    """A scalar or an inline list as an array: empty values, ``[]`` and null words give no element."""
    inner = F.regexp_extract(value, r"(?s)^\[(?!\[)(.*)\]$", 1)
    parts = F.when(value.rlike(r"(?s)^\[(?!\[).*\]$"), F.split(inner, ",")).otherwise(F.array(value))
    clean = F.transform(parts, lambda v: F.regexp_replace(F.regexp_replace(F.btrim(v), r"""^['"]|['"]$""", ""), r"^\[\[([^\]|#]+).*\]\]$", "$1"))
    return F.filter(clean, lambda v: ~F.lower(v).isin("", "[]", "null", "none", "~"))


def links(notes: DataFrame) -> DataFrame:
    """(src, pos, target, anchor, alias, embed) of wikilinks outside of code fences."""
    body = T.without_fences(F.col("text"))
    each = notes.where(F.contains("text", F.lit("[["))).select(F.col("path").alias("src"), F.posexplode(T.matches(body, WIKILINK)).alias("pos", "raw"))
    # One regular expression for each part, so that no part's expression holds another's several times over.
    inner = F.regexp_replace("raw", r"^!?\[\[|\]\]$", "")
    whole = F.regexp_extract(inner, r"(?s)^([^|]*?)(?:\\?\|.*)?$", 1)
    return each.select(
        "src", "pos",
        F.btrim(F.regexp_extract(whole, "^[^#]*", 0)).alias("target"),
        F.regexp_extract(whole, "(?s)^[^#]*#(.*)$", 1).alias("anchor"),
        F.regexp_extract(inner, r"(?s)^[^|]*\|(.*)$", 1).alias("alias"),
        F.col("raw").startswith("!").alias("embed"),
    )


def markdown_links(notes: DataFrame) -> DataFrame:
    """(src, pos, target, anchor) of markdown links, outside of code fences; a target that is empty is in the same note."""
    body = T.without_fences(F.col("text"))
    each = notes.where(F.contains(body, F.lit("]("))).select(F.col("path").alias("src"), F.posexplode(T.matches(body, MDLINK, 1)).alias("pos", "raw"))
    plain = F.regexp_extract("raw", '(?s)^[^"]*', 0)
    return each.select("src", "pos", F.btrim(F.regexp_extract(plain, "^[^#]*", 0)).alias("target"), F.btrim(F.regexp_extract(plain, "(?s)^[^#]*#(.*)$", 1)).alias("anchor"))


def all_links(notes: DataFrame) -> DataFrame:
    """(src, target, anchor) of wikilinks and markdown links."""
    return links(notes).select("src", "target", "anchor").unionByName(markdown_links(notes).select("src", "target", "anchor"))


def external(target: Column) -> Column:
    return (target == "") | target.startswith("#") | target.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:")


def heading_norm(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9 ]", ""), " +", " "))


def headings(notes: DataFrame) -> DataFrame:
    """(path, norm) of every heading."""
    rows = parsed(notes).select("path", F.explode(F.split(T.without_fences(F.col("body")), "\n")).alias("row"))
    return rows.where(F.col("row").rlike(HEADING)).select("path", heading_norm(F.regexp_extract("row", HEADING, 1)).alias("norm")).distinct()


def blocks(notes: DataFrame) -> DataFrame:
    """(path, id) of block marks at line ends."""
    rows = parsed(notes).select("path", F.explode(F.split(T.without_fences(F.col("body")), "\n")).alias("row"))
    return rows.where(F.col("row").rlike(BLOCK)).select("path", F.lower(F.regexp_extract("row", BLOCK, 1)).alias("id")).distinct()


def tags(notes: DataFrame) -> DataFrame:
    """(path, tag, origin): tags of the front matter (origin fm) and in the text (inline), each occurrence."""
    fm = fields(notes).where("field = 'tags'").select("path", "value")
    listed = F.when(F.col("value").startswith("["), values(F.col("value"))).otherwise(F.filter(F.split("value", r"[,\s]+"), lambda v: v != ""))
    front = fm.select("path", F.explode(listed).alias("tag"), F.lit("fm").alias("origin"))
    inline = parsed(notes).select("path", F.explode(T.matches(T.without_fences(F.col("body")), r"(?m)(?:^|\s)#([A-Za-z][\w/\-]+)", 1)).alias("tag"), F.lit("inline").alias("origin"))
    return front.unionByName(inline)
