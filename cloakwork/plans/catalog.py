"""The registered queries over the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boxes, contracts, events, pages, planner, privacy, records, reports

_PARTS = (privacy, boxes, records, events, contracts, pages, planner, reports)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLE: dict[str, str] = {k: sql for part in _PARTS for k, sql in part.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["a_flagship"](spark, sf_dir)
