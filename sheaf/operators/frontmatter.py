"""Front matter against a declared vocabulary, fixes, and inference of a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import notes as N
from sheaf.functions import text as T


def off_vocabulary(fields: DataFrame, vocab: DataFrame, outbox: list[str], outbox_type: str = "outbox") -> DataFrame:
    """(path, field, value) of values that their field's vocabulary (field, value) lacks.  The ``outbox`` statuses are allowed
    in notes of that type."""
    v = F.broadcast(vocab.select("field", F.col("value").alias("v")).distinct())
    each = fields.join(F.broadcast(vocab.select("field").distinct()), "field", "left_semi").select("path", "field", F.explode(N.values(F.col("value"))).alias("value"))
    bad = each.join(v, (each["field"] == v["field"]) & (each["value"] == v["v"]), "left_anti")
    if outbox:
        typed = fields.where((F.col("field") == "note_type") & (F.col("value") == outbox_type)).select("path").distinct()
        spared = bad.where((F.col("field") == "status") & F.col("value").isin(outbox)).join(typed, "path", "left_semi")
        bad = bad.join(spared.select("path", "field", "value").distinct(), ["path", "field", "value"], "left_anti")
    return bad


def missing(notes: DataFrame, fields: DataFrame, field: str) -> DataFrame:
    """The notes (path) with front matter that lack a field."""
    ok = N.parsed(notes).where("state = 'ok'").select("path")
    return ok.join(fields.where(F.col("field") == field).select("path").distinct(), "path", "left_anti")


def unknown(fields: DataFrame, known: list[str]) -> DataFrame:
    return fields.where(~F.col("field").isin(known)).select("path", "field")


def remap(fields: DataFrame, field: str, table: dict[str, str]) -> DataFrame:
    """(path, old, new) of a field's values that a table maps to others."""
    pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    f = fields.where(F.col("field") == field).select("path", F.col("value").alias("old"), pairs[F.col("value")].alias("new"))
    return f.where("new is not null and new <> old")


def date_fix(fields: DataFrame) -> DataFrame:
    """(path, action): a ``date`` that says the same day as ``created`` is dropped, one that stands alone becomes ``created``."""
    d = fields.where("field in ('date', 'created')").groupBy("path").agg(F.max(F.when(F.col("field") == "date", T.day(F.col("value")))).alias("date"), F.max(F.when(F.col("field") == "created", T.day(F.col("value")))).alias("created"))
    return d.select("path", F.when(F.col("date") == F.col("created"), "drop").when(F.col("created").isNull() & (F.col("date") != ""), "rename").alias("action")).where("action is not null")


def derived_type(path: Column, folders: list[tuple[str, str]], parts: list[tuple[str, str]]) -> Column:
    """A note's type: by what its path contains, else by its top folder; the first rule that holds decides."""
    out = F.lit(None).cast("string")
    for folder, kind in reversed(folders):
        out = F.when(F.split_part(path, F.lit("/"), F.lit(1)) == folder, kind).otherwise(out)
    for part, kind in reversed(parts):
        out = F.when(path.contains(part), kind).otherwise(out)
    return out


def infer(fields: DataFrame, most: int = 24) -> DataFrame:
    """(field, n_notes, n_values, kind, vocabulary): a field of at most ``most`` different values is an enumeration."""
    each = fields.select("path", "field", F.explode(N.values(F.col("value"))).alias("value"))
    distinct = each.groupBy("field", "value").agg(F.count("*").alias("n"))
    few = distinct.groupBy("field").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_uses"))
    words = distinct.join(few.where(F.col("n_values") <= most).select("field"), "field", "left_semi").groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("vocabulary"))
    return few.join(words, "field", "left").select("field", "n_uses", "n_values", F.when(F.col("n_values") <= most, "enum").otherwise("open").alias("kind"), "vocabulary")
