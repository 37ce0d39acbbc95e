"""The link graph of a collection: resolution, degrees, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import notes as N
from sheaf.tables import cut

MEDIA = "png jpg jpeg gif svg webp pdf mp3 mp4 mov wav excalidraw".split()


#: A name that ends in an extension: at most eight letters and digits, not digits alone (those belong to a dotted name).
EXTENSION = r"^\.*[^.].*\.(?![0-9]+$)[A-Za-z0-9]{1,8}$"
NOTE = r"\.(?:md|markdown)$"


def keys(files: DataFrame) -> DataFrame:
    """(kind, key, best): for each way to name a file the one that the name means, the least deep, then shortest path.  Kinds: path, a
    whole path or the end of one; bare, that without .md; name; stem, a note's name without its extension."""
    low = F.lower("path")
    parts = F.split(low, "/")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))
    f = files.select("path", suffixes.alias("suffixes"), F.element_at(parts, -1).alias("name"), n.alias("depth"))
    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("key"))
    whole = F.transform("suffixes", lambda s: kind("path", s))
    bare = F.transform(F.filter("suffixes", lambda s: s.endswith(".md")), lambda s: kind("bare", F.regexp_replace(s, r"\.md$", "")))
    single = F.array_compact(F.array(kind("name", F.col("name")), F.when(F.col("name").rlike(NOTE), kind("stem", F.regexp_replace("name", NOTE, "")))))
    each = f.select("path", "depth", F.explode(F.array_distinct(F.concat(whole, bare, single))).alias("k"))
    return each.groupBy("k.kind", "k.key").agg(F.min(F.struct("depth", F.length("path").alias("length"), "path")).alias("best"))


def resolve(links: DataFrame, files: DataFrame) -> DataFrame:
    """The links with the file that each leads to (``dst``), and ``state``: found, broken, or external.  Links to a place in the same
    note (an empty target, or one that begins with ``#``) are no links to files, and are left out.

    A target with a slash (or backslash) is a path or the end of one, with or without ``.md``; if there is none, its last part is
    looked up like a target without a slash: a file's name if it has an extension, else a note's stem, else a name.  Each
    distinct target is looked up once.  The links are kept, so that their texts are read and parsed once."""
    links = cut(links.where((F.coalesce(F.btrim("target"), F.lit("")) != "") & ~F.btrim("target").startswith("#")))
    t = F.lower(F.translate(F.btrim("target"), "\\", "/"))
    base = F.element_at(F.split(t, "/"), -1)
    ext, deep = base.rlike(EXTENSION), t.contains("/")
    way = lambda kind, key, rank, when: F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(rank).alias("rank")))
    ways = F.array_compact(F.array(way("path", t, 1, deep), way("bare", t, 1, deep & ~ext), way("name", base, 2, ext), way("stem", base, 2, ~ext), way("name", base, 3, ~ext)))
    wanted = links.select("target").distinct().where(~N.external(F.btrim("target"))).select("target", F.explode(ways).alias("w")).select("target", "w.*")
    found = wanted.join(keys(files), ["kind", "key"]).groupBy("target").agg(F.min(F.struct("rank", "best"))["best"]["path"].alias("dst"))
    state = F.when(F.col("dst").isNotNull(), "found").when(N.external(F.btrim("target")), "external").otherwise("broken")
    return links.join(found, "target", "left").withColumn("state", state)


def degrees(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, inbound, outbound) of each of the files: every occurrence of a link counts, outbound also those that are broken or lead
    outside of the collection."""
    end = lambda c, i, o: F.struct(F.col(c).alias("path"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = resolved.select(F.explode(F.array(end("dst", 1, 0), end("src", 0, 1))).alias("e")).select("e.*", F.lit(0).alias("own"))
    none = files.select("path", F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(1).alias("own"))
    sums = none.unionByName(ends.where("path is not null")).groupBy("path").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"), F.max("own").alias("own"))
    return sums.where("own = 1").drop("own")


def broken_anchors(resolved: DataFrame, notes: DataFrame) -> DataFrame:
    """(src, dst, anchor) of links to a note without that heading or block."""
    a = resolved.where("dst is not null and trim(anchor) <> ''").select("src", "dst", "anchor", F.regexp_replace(F.btrim("anchor"), "^#+", "").alias("a"))
    to_block = a.where(F.col("a").startswith("^")).withColumn("id", F.lower(F.substring("a", 2, 1 << 30)))
    to_head = a.where(~F.col("a").startswith("^")).withColumn("norm", N.heading_norm(F.col("a")))
    there = notes.select(F.col("path").alias("dst"))
    lost = to_head.join(N.headings(notes).withColumnRenamed("path", "dst"), ["dst", "norm"], "left_anti").select("src", "dst", "anchor").unionByName(to_block.join(N.blocks(notes).withColumnRenamed("path", "dst"), ["dst", "id"], "left_anti").select("src", "dst", "anchor"))
    return lost.join(there, "dst", "left_semi").select("src", "dst", "anchor")


def stem_collisions(files: DataFrame) -> DataFrame:
    """(stem, n, paths) of notes that share a stem."""
    s = files.where(F.lower("path").rlike(NOTE)).select("path", F.regexp_replace(F.lower(F.element_at(F.split("path", "/"), -1)), NOTE, "").alias("stem"))
    return s.groupBy("stem").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths")).where("n > 1")


def orphan_media(files: DataFrame, resolved: DataFrame) -> DataFrame:
    media = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(MEDIA)).select("path")
    return media.join(resolved.where("dst is not null").select(F.col("dst").alias("path")), "path", "left_anti")


def net_new(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """The findings (fingerprint, ...) that aren't in the baseline (fingerprint)."""
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def scoped(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings with ``in_scope``: whether their path has been changed; the others stay, to be counted."""
    c = changes.select("path").distinct().withColumn("hit", F.lit(True))
    return findings.join(c, "path", "left").withColumn("in_scope", F.coalesce("hit", F.lit(False))).drop("hit")
