"""Scalar functions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = (
    "the and for with from that this into over een der des van voor met het de en les pour avec dans sur note notes index readme overview meeting update draft final new old"
).split()
NAME_NOISE = "com org net www mail example info noreply no-reply mr mrs ms dr prof the van der den de le la".split()
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end opens no further line."""
    parts = F.split(text, _LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def without_fences(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("```")), F.regexp_replace(text, "(?s)```.*?```", "")).otherwise(text)


def said(text: Column) -> Column:
    """All words of the shape of a token, in lower case."""
    return F.transform(matches(text, r"[A-Za-z0-9][A-Za-z0-9'&.]{2,}"), lambda t: F.lower(F.btrim(t, F.lit(".'&"))))


def tokens(text: Column) -> Column:
    """Distinct tokens that can carry meaning: longer than two, no stopword, no number."""
    return F.array_distinct(F.filter(said(text), lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS) & ~t.rlike("^[0-9]+$")))


def name_parts(name: Column) -> Column:
    """Distinct parts of a person's name or address that tell people apart."""
    parts = F.split(F.lower(name), r"[\s,;<>()@._\-]+")
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) > 3) & ~p.isin(NAME_NOISE) & ~p.rlike("^[0-9]+$")))


def code_key(code: Column) -> Column:
    """A code's spelling for comparison: its alphanumeric runs in capitals, joined by hyphens."""
    return F.array_join(matches(F.upper(code), "[A-Z0-9]+"), "-")


def code_ngrams(text: Column) -> Column:
    """Keys of all runs of one to four parts of a name, of at least three characters and with a part that isn't a number, a
    single character or a stopword."""
    parts = matches(text, "[A-Za-z0-9]+")
    idle = lambda p: p.rlike("^[0-9]+$") | (F.length(p) < 2) | F.lower(p).isin(STOPWORDS)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.when(F.size(parts) >= n, F.transform(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.slice(parts, i, n))).otherwise(F.array().cast("array<array<string>>"))))
    kept = F.transform(F.filter(runs, lambda r: F.exists(r, lambda p: ~idle(p))), lambda r: F.upper(F.array_join(r, "-")))
    return F.array_distinct(F.filter(kept, lambda k: F.length(k) >= 3))


def fold(text: Column) -> Column:
    """Lower case, without the diacritics and typographic signs that keyboards leave out."""
    low = F.lower(text)
    for many, plain in (("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("ø", "o"), ("đ", "d"), ("ł", "l")):
        low = F.replace(low, F.lit(many), F.lit(plain))
    return F.translate(low, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ‘’“”–— ", "aaaaaaceeeeiiiinooooouuuuyy''\"\"-- ")


def tag_norm(tag: Column) -> Column:
    """The form that tags are merged by: lower case, without separators, without a plural s from four characters on."""
    t = F.translate(F.lower(tag), "#_-/", "")
    return F.when((F.length(t) >= 4) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def tag_norm_inventory(tag: Column) -> Column:
    """The form that the inventory groups tags by: a final s always goes, a ``#`` stays."""
    t = F.translate(F.lower(tag), "_-/", "")
    return F.when(t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def kebab_rank(tag: Column) -> Column:
    """How well a tag is spelt: 2 for lower case, 1 more for hyphens without other separators."""
    return F.when(tag == F.lower(tag), 2).otherwise(0) + F.when(F.contains(tag, F.lit("-")) & ~tag.rlike("[_/]"), 1).otherwise(0)


def dedash(name: Column) -> Column:
    return F.regexp_replace(name, r"\s+(?:--|—|–)\s+|—|–", " - ")


def kebab(name: Column) -> Column:
    """Words joined by hyphens in lower case; codes (with a digit) and acronyms keep their capitals."""
    words = F.filter(F.split(name, r"[\s_/\-—–]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[A-Z0-9]{2,}$"), w).otherwise(F.lower(w))), "-")


def title_from_name(stem: Column) -> Column:
    """The first " -- " of a name opens a subtitle, further ones list."""
    at = F.locate(" -- ", stem)
    rest = F.replace(F.substring(stem, at + 4, F.length(stem)), F.lit(" -- "), F.lit(", "))
    return F.when(at > 0, F.concat(F.substring(stem, F.lit(1), at - 1), F.lit(": "), rest)).otherwise(stem)


def day(value: Column) -> Column:
    """The leading ISO date of a value, quoted or not."""
    return F.regexp_extract(value, r"""^['"]?(\d{4}-\d{2}-\d{2})""", 1)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn test."""
    d = F.reverse(digits(number))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.when(F.substring(d, i, F.lit(1)).cast("int") > 4, F.substring(d, i, F.lit(1)).cast("int") * 2 - 9).otherwise(F.substring(d, i, F.lit(1)).cast("int") * 2)))
    return F.length(d).between(13, 19) & (F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0)


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def iban(number: Column) -> Column:
    """Whether an account number of 15 to 34 characters has the remainder 1 by 97."""
    n = F.upper(F.replace(number, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(n, F.lit(5), F.length(n)), F.substring(n, F.lit(1), F.lit(4)))
    codes = F.transform(chars(turned), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(codes, F.lit(0), lambda a, x: (F.when(x > 9, a * 100).otherwise(a * 10) + x) % 97)
    return F.length(n).between(15, 34) & (rest == 1)


def redact(secret: Column) -> Column:
    """Two characters at either end, at most eight stars between; short ones are stars alone."""
    n = F.length(secret)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(secret, F.lit(1), F.lit(2)), F.repeat(F.lit("*"), F.least(n - 4, F.lit(8))), F.substring(secret, n - 1, F.lit(2))))


def band(score: Column) -> Column:
    return F.when(score >= 60, "ACT-NOW").when(score >= 40, "REVIEW").when(score >= 20, "SCAN").otherwise("FYI")


def health_band(value: Column, green: float, yellow: float) -> Column:
    return F.when(value < green, "GREEN").when(value <= yellow, "YELLOW").otherwise("RED")


def content_hash(*parts: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of all parts, a NUL between."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def fingerprint(kind: str, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(kind), *parts)
