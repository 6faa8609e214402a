"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing to weights, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of documents; the last adds the shard and slot.
Each keeps all columns whatever their names, takes texts whole, and gives an empty
result for an empty table.  Between stages the rows are written as Parquet to the shared folder and read again; a stage's rows are
deleted when the next one's are written, so that only those of the last remain.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import decontaminate, mixing, neardup, quality, sharding
from cloakwork.llm.common import read_table, released, shared_folder


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts fail the base rule, repeated rows and rows of one doc_id follow their own text."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more; repeated rows are one document, wordless ones have no group."""
    return neardup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, each by its own text; null and empty texts hold none, and items of under 24 bytes aren't looked for."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it: texts without words are never taken, a null source is one of its own, repeated rows are each dealt."""
    return mixing.mix_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there, which take the place of columns of these names; null and empty texts and repeated rows have places like all others."""
    return sharding.shard(docs)


STAGES = [
    ("quality rules", drop_low_quality),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            _delete(spark, f"{folder}/{n - 1}")
        released(spark)
    return docs


#: SQL can't express the stages' histograms, sketches and alignments; tests hold run() against brute force.
ORACLE_SQL = None
