"""Reading collections from files, and the small configuration files beside them."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDE = (".obsidian", ".claude", ".git", ".trash")
ITEM = "id string, title string, body string, participants array<string>, codes array<string>, topics array<string>, date date"
CANVAS = "nodes array<struct<id: string, type: string, file: string>>"


def under(path, prefixes) -> F.Column:
    """Whether a relative path is one of the prefixes or below one."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p.rstrip("/") + "/")
    return out


def listing(spark: SparkSession, root: str, glob: str | None = None, exclude: tuple[str, ...] = EXCLUDE, content: bool = True) -> DataFrame:
    """(path, mtime, size[, content]) of the files below ``root``, paths relative to it; directories whose names begin with a dot
    and excluded prefixes are left out.  Spark's readers skip files whose names begin with ``_`` or ``.``: see ``local``."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (base.option("pathGlobFilter", glob) if glob else base).load(root)
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.split(F.col("path"), F.lit(r"\Q" + prefix + r"\E"), 2)[1], "^/+", "")
    columns = [rel.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")] + ([F.col("content")] if content else [])
    out = raw.select(*columns)
    return out.where(~F.col("path").rlike(r"(^|/)\.[^/]+/") & ~under(F.col("path"), exclude))


def local(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".md",), exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """(path, text) of a small collection on the driver's disk, with files whose names begin with ``_`` or ``.``."""
    rows = []
    for folder, names, files in os.walk(root):
        rel = Path(folder).relative_to(root).as_posix()
        names[:] = sorted(n for n in names if not n.startswith(".") and not any((n if rel == "." else f"{rel}/{n}") == e for e in exclude))
        for f in sorted(files):
            if f.endswith(suffixes):
                rows.append((f if rel == "." else f"{rel}/{f}", (Path(folder) / f).read_bytes().decode("utf-8", "replace")))
    return spark.createDataFrame(rows, "path string, text string")


def notes(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """(path, text) of the markdown files below ``root``."""
    return listing(spark, root, "*.md", exclude).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of markdown and text files."""
    return listing(spark, root, "*.{md,markdown,txt}").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def canvas_links(files: DataFrame) -> DataFrame:
    """(src, target) of file nodes in canvases (path, text); what isn't JSON has none."""
    nodes = files.where(F.col("path").endswith(".canvas")).select(F.col("path").alias("src"), F.explode(F.from_json("text", CANVAS)["nodes"]).alias("n"))
    return nodes.where("n.type = 'file' and n.file is not null").select("src", F.col("n.file").alias("target"))


def base_links(files: DataFrame) -> DataFrame:
    """(src, target) of quoted file names in ``.base`` views (path, text)."""
    ref = r"""(?i)["']([^"']+\.(?:md|canvas|png|jpe?g|gif|svg|webp|pdf|excalidraw))["']"""
    return files.where(F.col("path").endswith(".base")).select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(ref), F.lit(1))).alias("target"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """Items from a file of a JSON object or list; a field that isn't declared is an error."""
    raw = json.loads(Path(path).read_text())
    raw = raw if isinstance(raw, list) else [raw]
    known = {f.split()[0] for f in ITEM.split(", ")}
    for r in raw:
        if set(r) - known:
            raise ValueError(f"unknown fields: {sorted(set(r) - known)}")
    return spark.read.schema(ITEM).option("mode", "FAILFAST").json(spark.sparkContext.parallelize([json.dumps(r) for r in raw]))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a list file: blank lines and comments are left out."""
    return spark.read.text(path).select(F.btrim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(spark, path).select(F.col("value").alias("fingerprint")).distinct()


def write_baseline(findings: DataFrame, path: str) -> None:
    findings.select("fingerprint").distinct().orderBy("fingerprint").coalesce(1).write.mode("overwrite").text(path)


def denylist(spark: SparkSession, path: str) -> DataFrame:
    """(term, example) of a denylist with ``# example:`` notes behind its terms."""
    raw = lines_of(spark, path)
    example = F.regexp_extract("value", r"(?i)#\s*example:\s*(.+?)\s*$", 1)
    return raw.select(F.btrim(F.regexp_replace("value", r"(?i)\s*#\s*example:.*$", "")).alias("term"), F.nullif(example, F.lit("")).alias("example"))


def headers(files: DataFrame, most: int = 40) -> DataFrame:
    """(path, field, value) of ``@field: value`` lines among a file's first ones."""
    rows = files.select("path", F.posexplode(F.slice(F.split("text", "\n"), 1, most)).alias("pos", "row"))
    p = r"^\W*@([a-z][\w-]*):\s*(.*?)\s*$"
    return rows.where(F.col("row").rlike(p)).select("path", F.regexp_extract("row", p, 1).alias("field"), F.regexp_extract("row", p, 2).alias("value"))


def proposals(spark: SparkSession, path: str) -> DataFrame:
    """(path, old, new, note) of a reviewed table of proposals."""
    return spark.read.schema("path string, old string, new string, note string").csv(path, sep="\t", comment="#")


def publish(root: str, changes: DataFrame, zones: tuple[str, ...] = ()) -> int:
    """Writes (path, text) below ``root`` from the driver, each by a new file that replaces the old one.  Paths that lead outside,
    through a link, or into a forbidden zone are refused before anything is written."""
    rows = changes.select("path", "text").collect()
    real = Path(root).resolve()
    for r in rows:
        target = real / r.path
        if target.is_symlink() or not target.resolve().is_relative_to(real):
            raise ValueError(f"outside of the collection: {r.path}")
        if any(r.path == z or r.path.startswith(z.rstrip("/") + "/") for z in zones):
            raise ValueError(f"in a forbidden zone: {r.path}")
    for r in rows:
        target = real / r.path
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(target.name + ".part")
        part.write_bytes(r.text.encode())
        part.replace(target)
    return len(rows)
