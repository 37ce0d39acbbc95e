"""Tag inventory and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text as T


def counts(tags: DataFrame) -> DataFrame:
    """(tag, n_notes): how many notes carry each tag, wherever in the note."""
    return tags.select("path", "tag").distinct().groupBy("tag").agg(F.count("*").alias("n_notes"))


def proposals(counted: DataFrame) -> DataFrame:
    """(norm, canonical, variant, n_notes): which spelling of a tag should become which.  The best spelt one wins, then the
    most used, then the first in order."""
    c = counted.withColumn("norm", T.tag_norm(F.col("tag"))).withColumn("rank", T.kebab_rank(F.col("tag")))
    w = Window.partitionBy("norm")
    first = F.first("tag").over(w.orderBy(F.desc("rank"), F.desc("n_notes"), "tag").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return c.withColumn("canonical", first).where("tag <> canonical").select("norm", "canonical", F.col("tag").alias("variant"), "n_notes")


def near_duplicates(tags: DataFrame) -> DataFrame:
    """(norm, n_variants, variants, uses) of inventory groups with several spellings."""
    c = tags.groupBy("tag").agg(F.count("*").alias("uses"))
    g = c.groupBy(T.tag_norm_inventory(F.col("tag")).alias("norm")).agg(F.count("*").alias("n_variants"), F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("variants"), F.sum("uses").alias("uses"))
    return g.where("n_variants > 1")


def rewrites(tags: DataFrame, proposed: DataFrame) -> DataFrame:
    """(path, old, new) of every tag to be changed."""
    p = proposed.select(F.col("variant").alias("tag"), "canonical")
    return tags.select("path", "tag").distinct().join(p, "tag").select("path", F.col("tag").alias("old"), F.col("canonical").alias("new"))
