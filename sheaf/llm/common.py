"""What several operators of this subpackage need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the shared checkpoint folder, so that a lost executor loses nothing.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset, as in tests on one machine, is one made."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared(spark: SparkSession) -> str:
    """The application's folder below the shared one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master != "local" and not (context.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sheaf-checkpoint-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder, read again."""
    path = f"{_shared(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def placed(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with equal ``key`` (an int below ``n``) in one partition of their own, so that no two keys need share a task."""
    return df.repartitionById(n, F.col(key).cast("int"))


def lowered(text: Column) -> Column:
    """The text as the kernel wants it; null is the empty text."""
    return F.lower(F.coalesce(text, F.lit("")))


def own(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns.  Operators compute on these alone, so that further columns of the caller, whatever their
    names, can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
