"""Parquet tables as streams and streams as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import deleted, shared_folder, table, written_once
from .limits import ROCKSDB

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 64) -> DataFrame:
    """A table's files as a stream, so many of them a micro-batch, so that a batch's rows stay within bounds.

    The path is a pattern for this one name, as a stream takes a single file only from a pattern.
    """
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", files)
    return reader.parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """The rows that the stream yields from all there is now, written once to files in a shared folder, as a table.

    A query that is begun again on the same folder goes on where the one before ended.  State is kept in
    RocksDB; the session's own setting is as before when the query is over.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
        writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drained(stream: DataFrame) -> DataFrame:
    """The rows of a stream that is read once: its folder goes when they are in a checkpoint."""
    folder = shared_folder(stream.sparkSession)
    rows = written_once(drain(stream, folder))
    deleted(stream.sparkSession, folder)
    return rows
