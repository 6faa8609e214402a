"""Tables as DataFrames, spread for costly work on each row."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Stored bytes of the input for each partition of a shuffle, and the size that Spark gives to a source whose size it doesn't know.
PART_BYTES, _UNKNOWN = 4 << 20, 1 << 60
#: The same for pages, of which a task finds the private spans, and for planned sessions: a row of few stored bytes can take long.
PAGE_PART = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; one of its own only on a single machine that names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="stream-")


def spread(rows: DataFrame, part: int | None = None) -> DataFrame:
    """The rows on at least as many partitions as there are cores.

    A small file is one partition, however costly its rows are.  Only a scan with fewer partitions than
    cores is dealt anew, so a table that is large enough to keep the cluster busy is never shuffled.
    With ``part``, for short rows of which long work is made, they are always dealt anew, a partition for each so many stored
    bytes: a scan can have more partitions than its file has row groups, and then most of them have no row.
    """
    if part:
        return rows.repartition(parts_of(rows, part))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.toJavaRDD().getNumPartitions() < cores else rows


def spread_by(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key for costly work on each group: as many partitions as cores or shuffle partitions.

    A group-by on the key needs no further shuffle, and partitions are not joined by their size in bytes, which says
    little about the work.
    """
    session = rows.sparkSession
    n = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, key)


def stored_bytes(rows: DataFrame) -> int:
    """Bytes of the files that the rows are read from; sources of unknown size are left out."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < _UNKNOWN)


def parts_of(rows: DataFrame, part: int = PART_BYTES) -> int:
    """Partitions for costly work on the rows: one for so many stored bytes, never fewer than cores or shuffle partitions."""
    session = rows.sparkSession
    least = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-stored_bytes(rows) // part))


def dealt(rows: DataFrame, *keys: str, part: int = PART_BYTES) -> DataFrame:
    """The rows dealt by keys to partitions whose number grows with the input, so that what a task sorts and holds doesn't.

    As with ``spread_by`` a group-by or window on the keys needs no further shuffle, and there are at least as many
    partitions as cores or shuffle partitions.
    """
    return rows.repartition(parts_of(rows, part), *keys)


def written_once(rows: DataFrame) -> DataFrame:
    """The rows in a checkpoint in the shared folder, so that what they were made from can go."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
