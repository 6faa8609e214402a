"""Run reports as JSON files: read against a fixed schema with faulty ones kept apart, written as lines.

A report is one object, on a line of its own or in a file of its own.  What doesn't parse, or
lacks what a report must have, isn't dropped: it comes back as a fault with its text or the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of a report: its run, when it was made, what it was made from, and its steps.
REPORT = "runId string, generatedAt timestamp, sourceFingerprint string, steps array<struct<name:string,exitCode:int,fresh:boolean,elapsedMs:bigint>>"
_BROKEN = "_broken"


def read_reports(spark: SparkSession, path: str, schema: str = REPORT, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reports, faults): rows of the schema with their ``file``, and (file, text, reason) of what isn't one.

    A report has a run, a time, and steps that each have a name and an exit code.
    """
    reader = spark.read.schema(f"{schema}, {_BROKEN} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)
    rows = reader.option("multiLine", whole_files).json(path).withColumn("file", F.col("_metadata.file_name"))
    columns = [c for c in rows.columns if c != _BROKEN]
    reason = fault()
    faults = rows.filter(reason.isNotNull())
    kept = F.coalesce(F.col(_BROKEN), F.to_json(F.struct(*[c for c in columns if c != "file"])))
    return rows.filter(reason.isNull()).select(*columns), faults.select("file", kept.alias("text"), reason.alias("reason"))


def fault() -> Column:
    """Why a row isn't a report; null if it is one."""
    bare = F.exists("steps", lambda s: s.isNull() | s["name"].isNull() | s["exitCode"].isNull())
    return (
        F.when(F.col(_BROKEN).isNotNull(), "not JSON of this schema").when(F.col("runId").isNull() | (F.col("runId") == ""), "no run").when(F.col("generatedAt").isNull(), "no time")
        .when(F.col("steps").isNull(), "no steps").when(F.coalesce(bare, F.lit(True)), "a step without name or code")
    )


def write_reports(reports: DataFrame, path: str, by: str | None = None) -> None:
    """A line for each report, nulls written out, so that what is read back is what was written; a folder for each value of ``by``."""
    writer = reports.write.option("ignoreNullFields", False).option("compression", "gzip")
    (writer.partitionBy(by) if by else writer).json(path)


def gates(reports: DataFrame, fingerprint: Column) -> DataFrame:
    """(runId, steps, passed, stale, slowest, all_passed): a step passes if it is fresh and ended with 0; all do on an unchanged source."""
    passed = F.size(F.filter("steps", lambda s: (s["exitCode"] == 0) & F.coalesce(s["fresh"], F.lit(False))))
    stale = F.size(F.filter("steps", lambda s: ~F.coalesce(s["fresh"], F.lit(False))))
    unchanged = F.coalesce(F.col("sourceFingerprint") == fingerprint, F.lit(False))
    return reports.select(
        "runId", F.size("steps").cast("long").alias("steps"), passed.cast("long").alias("passed"), stale.cast("long").alias("stale"),
        F.array_max(F.transform("steps", lambda s: s["elapsedMs"])).alias("slowest"), (unchanged & (passed == F.size("steps"))).alias("all_passed"),
    )
