"""Manifests against the state of files, and the roll-up of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vendored(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(local, state) of entries (local, upstream, upstream_sha256, why) against files (path, sha256); those in order aren't
    listed."""
    j = entries.join(files.select(F.col("path").alias("upstream"), F.col("sha256").alias("now")), "upstream", "left")
    state = (
        F.when(F.col("local").isNull() | F.col("upstream").isNull(), "malformed")
        .when(F.coalesce("why", F.lit("")) == "", "unexplained")
        .when(F.col("now").isNull(), "upstream-absent")
        .when(F.col("upstream_sha256").isNull(), "never-reconciled")
        .when(F.col("now") != F.col("upstream_sha256"), "upstream-moved")
    )
    return j.select("local", state.alias("state")).where("state is not null")


def custody(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state) of artifacts (path, disposition, counterpart) against files (path, mtime, tracked, ignored); one artifact
    may be in several states."""
    f = files.select(F.col("path"), "mtime", "tracked", "ignored")
    c = files.select(F.col("path").alias("counterpart"), F.col("mtime").alias("c_mtime"), F.col("tracked").alias("c_tracked"))
    j = artifacts.join(f, "path", "left").join(c, "counterpart", "left")
    there = F.col("mtime").isNotNull()
    states = F.array(
        F.when(~there, "missing"),
        F.when(there & (F.col("disposition") == "committed") & ~F.col("tracked"), "untracked"),
        F.when(there & (F.col("disposition") != "committed") & ~F.col("tracked") & ~F.col("ignored"), "unignored-gap"),
        F.when(there & (F.col("disposition") == "encrypted") & F.col("c_mtime").isNull(), "counterpart-missing"),
        F.when(there & (F.col("disposition") == "encrypted") & (F.col("c_mtime") < F.col("mtime")), "counterpart-stale"),
        F.when(there & (F.col("disposition") == "encrypted") & ~F.col("c_tracked"), "counterpart-untracked"),
    )
    return j.select("path", F.explode(F.filter(states, lambda s: s.isNotNull())).alias("state"))


def receipts(expected: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """(name, state) of receipts (name, path, max_age_hours) that are missing or older than allowed at ``now``."""
    j = expected.join(files.select("path", "mtime"), "path", "left")
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("mtime")) / 3.6e9
    return j.select("name", F.when(F.col("mtime").isNull(), "receipt-missing").when(age > F.col("max_age_hours"), "receipt-stale").alias("state")).where("state is not null")


def hooks(state: DataFrame) -> DataFrame:
    """(repo, state) of hooks (repo, hooks_path, path_exists, hook, tracked, shadowed, wired) that don't guard."""
    s = F.when(F.col("hooks_path").isNotNull() & ~F.col("path_exists"), "hookspath-missing").when(F.col("shadowed"), "shadowed").when(~F.col("tracked"), "untracked-gate").when(~F.col("wired"), "not-wired")
    return state.select("repo", s.alias("state")).where("state is not null")


def paths(state: DataFrame) -> DataFrame:
    """(path, state) of references (path, kind, target_exists, stale) that lead nowhere."""
    s = F.when((F.col("kind") == "worktree") & ~F.col("target_exists"), "worktree-broken").when((F.col("kind") == "worktree") & F.col("stale"), "worktree-stale").when((F.col("kind") == "editable") & ~F.col("target_exists"), "editable-install").when((F.col("kind") == "symlink") & ~F.col("target_exists"), "broken-link").when((F.col("kind") == "hookspath") & ~F.col("target_exists"), "hookspath-missing")
    return state.select("path", s.alias("state")).where("state is not null")


def rollup(results: DataFrame) -> DataFrame:
    """(state, n, engines) of results (engine, exit, advisory): 0 ok, 1 fail, 2 skipped, anything else an error; an advisory
    engine that exits with 1 is an error as well."""
    state = F.when(F.col("exit") == 0, "ok").when((F.col("exit") == 1) & ~F.col("advisory"), "fail").when(F.col("exit") == 2, "skipped").otherwise("error")
    return results.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("engine")), ",").alias("engines"))
