"""Metadata values against a register of identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import notes as N
from sheaf.tables import cut

COMPOUND = r"^([A-Za-z0-9][\w.-]*)\s*[/|,;+]\s*([A-Za-z0-9][\w.-]*)$"


def _lookup(values: DataFrame, column: str, entities: DataFrame, aliases: DataFrame, to: str) -> DataFrame:
    """Adds ``to`` (the identifier) and ``to_how`` (exact or alias; null: not known)."""
    e = entities.select(F.col("id").alias("e_id"))
    a = aliases.select(F.lower("alias").alias("a_alias"), F.col("id").alias("a_id")).dropDuplicates(["a_alias"])
    j = values.join(e, values[column] == e["e_id"], "left").join(a, F.lower(values[column]) == a["a_alias"], "left")
    return j.withColumn(to, F.coalesce("e_id", "a_id")).withColumn(f"{to}_how", F.when(F.col("e_id").isNotNull(), "exact").when(F.col("a_id").isNotNull(), "alias")).drop("e_id", "a_id", "a_alias")


def conformance(fields: DataFrame, entities: DataFrame, aliases: DataFrame, tier_fields: DataFrame) -> DataFrame:
    """(path, field, value, state, canonical) of values of registered fields (tier, field) that aren't as registered: an alias,
    two identifiers in one value, unknown, or under another tier's field.  ``entities`` has (id, tier), ``aliases`` (alias, id)."""
    v = fields.join(F.broadcast(tier_fields.select("field").distinct()), "field", "left_semi").select("path", "field", F.explode(N.values(F.col("value"))).alias("value"))
    r = _lookup(v, "value", entities, aliases, "ident")
    r = r.withColumn("x", F.regexp_extract("value", COMPOUND, 1)).withColumn("y", F.regexp_extract("value", COMPOUND, 2))
    r = _lookup(_lookup(r, "x", entities, aliases, "xi"), "y", entities, aliases, "yi")
    t = entities.join(tier_fields.withColumnRenamed("field", "expected"), "tier").select(F.col("id").alias("ident"), "expected")
    r = r.join(t, "ident", "left")
    state = F.when(F.col("ident_how") == "alias", "alias").when(F.col("ident").isNull() & F.col("xi").isNotNull() & F.col("yi").isNotNull(), "compound").when(F.col("ident").isNull(), "unknown").when(F.col("expected") != F.col("field"), "wrong-category")
    return r.withColumn("state", state).where("state is not null").select("path", "field", "value", "state", F.when(F.col("state") == "compound", F.concat_ws("+", "xi", "yi")).otherwise(F.col("ident")).alias("canonical"))


def ancestors(edges: DataFrame, kind: str = "parent") -> DataFrame:
    """(id, ancestor, depth): the chain along the first edge of each identifier (src, type, dst; first by ``pos`` where edges have it,
    else by dst), nearest first, however long.  A cycle ends where it would come back.  Chains double in each round, so that
    there are as many rounds as the longest one's depth has binary digits; each is kept by a checkpoint."""
    first = F.min_by("dst", "pos") if "pos" in edges.columns else F.min("dst")
    up = edges.where(F.col("type") == kind).groupBy("src").agg(first.alias("up"))
    has = up.select(F.col("src").alias("next"), F.lit(True).alias("has"))
    one = up.select(F.col("src").alias("id"), F.array_distinct(F.array("src", "up")).alias("chain"), (F.col("src") == F.col("up")).alias("done"), F.col("up").alias("next"))
    now = cut(one.join(has, "next", "left").select("id", "chain", (F.col("done") | F.col("has").isNull()).alias("done")))
    while not now.where("not done").isEmpty():
        ahead = now.select(F.col("id").alias("at"), F.col("chain").alias("more"), F.col("done").alias("ended"))
        open_ = now.where("not done").join(ahead, F.element_at("chain", -1) == F.col("at"))
        both = F.concat("chain", F.slice("more", F.lit(2), F.size("more")))
        # What comes again begins a cycle, of which all that follows comes again too.
        grown = open_.select("id", F.array_distinct(both).alias("chain"), (F.col("ended") | (F.size(F.array_distinct(both)) < F.size(both)) | (F.size("more") == 1)).alias("done"))
        now = cut(now.where("done").unionByName(grown))
    return now.select("id", F.posexplode("chain").alias("depth", "ancestor")).where("depth > 0").select("id", "ancestor", "depth")


def enforcement(source: str) -> dict[str, bool]:
    """What may be done about a finding, by where the register has its entry from."""
    return {"decided": {"enforce": True, "fix": True}, "harvested": {"enforce": True, "fix": False}}.get(source, {"enforce": False, "fix": False})
