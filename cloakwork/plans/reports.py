"""Run reports made from orders and their lines: written, read back, held against gates; and what of them is faulty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import reports
from ..sources.tables import deleted, shared_folder, table, written_once

_FAULTS = "CASE o_orderkey % 10 WHEN 3 THEN 'cut' WHEN 5 THEN 'no run' WHEN 7 THEN 'no time' WHEN 9 THEN 'bare step' ELSE '' END"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON for each order; one in ten is cut off, and others lack something."""
    step = F.struct(
        F.expr("CASE WHEN o_orderkey % 10 = 9 AND l_linenumber = 1 THEN NULL ELSE l_returnflag END").alias("name"), F.expr("CAST(l_partkey % 3 = 0 AS INT)").alias("exitCode"),
        F.expr("l_suppkey % 5 <> 0").alias("fresh"), F.expr("l_suppkey * 10 + l_linenumber").alias("elapsedMs"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(table(spark, sf_dir, "lineitem"), F.expr("o_orderkey = l_orderkey")).groupBy("o_orderkey", "o_orderdate")
    made = rows.agg(F.sort_array(F.collect_list(F.struct("l_linenumber", step.alias("s")))).alias("s"))
    report = F.to_json(
        F.struct(
            F.expr("CASE WHEN o_orderkey % 10 <> 5 THEN 'run-' || CAST(o_orderkey AS STRING) END").alias("runId"), F.expr("CASE WHEN o_orderkey % 10 <> 7 THEN CAST(o_orderdate AS TIMESTAMP) END").alias("generatedAt"),
            F.expr("'f' || CAST(o_orderkey % 4 AS STRING)").alias("sourceFingerprint"), F.transform("s", lambda x: x["s"]).alias("steps"),
        )
    )
    cut = F.when(F.expr(_FAULTS) == "cut", F.substr("j", F.lit(1), F.length("j") - 5)).otherwise(F.col("j"))
    return made.withColumn("j", report).select(cut.alias("value"))


def j01_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports read from lines, written as JSON by their source, read back and held against the gates."""
    folder = shared_folder(spark)
    _lines(spark, sf_dir).write.text(f"{folder}/in")
    good, _ = reports.read_reports(spark, f"{folder}/in")
    reports.write_reports(good.drop("file").withColumn("source", F.col("sourceFingerprint")), f"{folder}/out", "source")
    again, _ = reports.read_reports(spark, f"{folder}/out")
    rows = written_once(reports.gates(again, F.lit("f0")))
    deleted(spark, folder)
    return rows


_LINES = f"""l AS (SELECT o_orderkey AS k, {_FAULTS} AS fault, count(*) AS steps, count(*) FILTER (l_partkey % 3 <> 0 AND l_suppkey % 5 <> 0) AS passed, count(*) FILTER (l_suppkey % 5 = 0) AS stale,
  max(l_suppkey * 10 + l_linenumber) AS slowest, bool_or(l_linenumber = 1) AS first FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""
J01 = f"WITH {_LINES} SELECT 'run-' || k AS runId, steps, passed, stale, slowest, k % 4 = 0 AND passed = steps AS all_passed FROM l WHERE fault = '' OR fault = 'bare step' AND NOT first"


def j02_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines are no reports, by reason."""
    folder = shared_folder(spark)
    _lines(spark, sf_dir).write.text(f"{folder}/in")
    _, faults = reports.read_reports(spark, f"{folder}/in")
    rows = written_once(faults.groupBy("reason").agg(F.count("*").alias("n")))
    deleted(spark, folder)
    return rows


J02 = f"""WITH {_LINES} SELECT CASE fault WHEN 'cut' THEN 'not JSON of this schema' WHEN 'bare step' THEN 'a step without name or code' ELSE fault END AS reason, count(*) AS n
FROM l WHERE fault <> '' AND (fault <> 'bare step' OR first) GROUP BY 1"""

QUERIES = {"j01_reports": j01_reports, "j02_faults": j02_faults}
ORACLE = {"j01_reports": J01, "j02_faults": J02}
