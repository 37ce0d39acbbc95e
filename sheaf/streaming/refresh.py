"""Incremental refresh: notes are parsed again only where their content has changed.

The reference set of signatures is a snapshot (path, sig, ...).  A batch run compares a full listing with it; a stream run gets
new versions of notes as they arrive, and merges what it parses into the snapshot with each micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def signature(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(content, 256), 1, 32))


def changes(snapshot: DataFrame, now: DataFrame) -> DataFrame:
    """(path, action): added, changed or removed between a snapshot and a full listing, each (path, sig); others aren't
    listed."""
    o = snapshot.select("path", F.col("sig").alias("old"))
    j = now.select("path", F.col("sig").alias("new")).join(o, "path", "full")
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return j.select("path", action.alias("action")).where("action is not null")


def merged(snapshot: DataFrame, listing: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The next snapshot: kept rows of unchanged notes, and rows that ``parse`` makes of those (path, text, sig) that are new or
    have changed; notes that the listing lacks are dropped."""
    keep = snapshot.join(listing.select("path", "sig"), ["path", "sig"], "left_semi")
    return keep.unionByName(parse(listing.join(snapshot.select("path", "sig"), ["path", "sig"], "left_anti")))


def stream(arrivals: DataFrame, target: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Keeps ``target`` up to date with a stream of note versions (path, text, ts): of several versions in a batch the last one
    counts, and only changed ones are parsed.  Each micro-batch writes a version of its own under ``target``; ``_version`` names
    the current one, and is replaced last, so that readers see whole versions and a repeated batch changes nothing."""
    root = Path(target)

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = Window.partitionBy("path").orderBy(F.desc("ts"))
        new = batch.withColumn("r", F.row_number().over(last)).where("r = 1").select("path", "text", signature(F.col("text")).alias("sig"))
        mark = root / "_version"
        at = json.loads(mark.read_text()) if mark.exists() else None
        if at is not None and at["batch"] >= number:
            return
        if at is None:
            out = parse(new)
        else:
            old = spark.read.parquet(str(root / f"v{at['batch']}"))
            fresh = new.join(old.select("path", "sig"), ["path", "sig"], "left_anti")
            out = old.join(fresh.select("path"), "path", "left_anti").unionByName(parse(fresh))
        out.write.mode("overwrite").parquet(str(root / f"v{number}"))
        part = root / "_version.part"
        part.write_text(json.dumps({"batch": number}))
        part.replace(mark)

    return arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
