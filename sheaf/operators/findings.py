"""The common form of findings, and its renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("engine", "rule", "severity", "path", "line", "message", "fingerprint")


def findings(df: DataFrame, engine: str, rule: Column | str, path: str, message: Column, severity: Column | str = "warning", line: Column | None = None, fingerprint: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    fp = fingerprint if fingerprint is not None else F.concat_ws("|", lit(rule), F.col(path))
    return df.select(F.lit(engine).alias("engine"), lit(rule).alias("rule"), lit(severity).alias("severity"), F.col(path).alias("path"), (line if line is not None else F.lit(1)).cast("int").alias("line"), message.alias("message"), fp.alias("fingerprint"))


def sarif(found: DataFrame, version: str = "1") -> DataFrame:
    """One row (sarif): the findings of each engine as a run of SARIF 2.1.0.  A report is read whole by its reader; findings are
    narrowed by baseline and scope before they are rendered."""
    result = F.struct(
        F.col("rule").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("fingerprint").alias("primary/v1")).alias("partialFingerprints"),
    )
    runs = found.groupBy("engine").agg(F.array_sort(F.collect_set(F.struct(F.col("rule").alias("id")))).alias("rules"), F.array_sort(F.collect_list(result)).alias("results"))
    run = F.struct(F.struct(F.struct(F.col("engine").alias("name"), F.lit(version).alias("version"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return runs.agg(F.array_sort(F.collect_list(run)).alias("runs")).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), "runs")).alias("sarif"))
