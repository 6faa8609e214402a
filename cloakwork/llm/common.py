"""What the operators of this subpackage share: words, checkpoints, hashed cells and running totals."""

from __future__ import annotations

import gc
import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters that are neither a space nor one of \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in a cell of running_totals(), about.
CELL_ROWS = 512
HASH_BITS = 60
#: Rows that one row of an expanding step makes.
CHUNK = 4096
#: A key with more than one in so many rows is hot.
HOT_PARTS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of its own only on a single machine that names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, with the lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The rows, written as Parquet to a folder in the shared one, and read again."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def deleted(spark: SparkSession, folder: str) -> None:
    """Delete a folder that :func:`stored` wrote."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let the driver drop finished steps now, so that Spark's cleaner deletes their shuffle files from the executors' disks.

    Files go when the driver's garbage collector finds their steps unused, which on a driver with little to do may be hours later.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows as one struct ``_row`` beside the given columns, so that no name of theirs can clash."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("_row")
    return docs.select(row, *[v.alias(k) for k, v in columns.items()])


def unpacked(rows: DataFrame, names: list[str], **added: Column) -> DataFrame:
    """The columns in ``_row`` and the added ones; an added column takes the place of one of its name."""
    rows = rows.select("_row", *[v.alias(f"_new_{n}") for n, v in enumerate(added.values())])
    kept = [F.col("_row").getField(c).alias(c) for c in names if c not in added]
    return rows.select(*kept, *[F.col(f"_new_{n}").alias(k) for n, k in enumerate(added)])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*columns: Column) -> Column:
    """A number below 2**60 from the MD5 of the columns as text, so that SQL elsewhere can make it too."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def cell_bits(rows: int) -> int:
    return max(0, math.ceil(math.log2(max(1, rows) / CELL_ROWS)))


def running_totals(
    df: DataFrame, group: str, place: str, ties: list[str], measures: dict[str, str], bits: int
) -> DataFrame:
    """Add for each measure its sum over the rows before this one in the group, ordered by place and ties.

    ``place`` is spread evenly over [0, 2**60).  Rows are summed in cells of the
    leading bits of ``place``, cells within coarse cells, and coarse cells within
    the group, so no task holds more than about a cell or the square root of the
    cells, however large one group is.  ``group`` must not be null.
    """
    coarse = bits // 2
    fine = F.shiftrightunsigned(F.col(place), HASH_BITS - bits) if bits else F.lit(0).cast("long")
    df = df.withColumn("_cell", fine)
    before = (Window.unboundedPreceding, -1)
    sums = [F.sum(F.col(m)).alias(f"_s_{m}") for m in measures]
    cells = df.groupBy(group, "_cell").agg(*sums).withColumn("_top", F.shiftright(F.col("_cell"), bits - coarse))
    tops = cells.groupBy(group, "_top").agg(*[F.sum(f"_s_{m}").alias(f"_t_{m}") for m in measures])

    def earlier(window, column: str) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(*before)), F.lit(0))

    over_tops = Window.partitionBy(group).orderBy("_top")
    over_cells = Window.partitionBy(group, "_top").orderBy("_cell")
    over_rows = Window.partitionBy(group, "_cell").orderBy(place, *ties)
    tops = tops.select(group, "_top", *[earlier(over_tops, f"_t_{m}").alias(f"_a_{m}") for m in measures])
    cells = cells.join(tops, [group, "_top"]).select(
        group, "_cell", *[(F.col(f"_a_{m}") + earlier(over_cells, f"_s_{m}")).alias(f"_b_{m}") for m in measures]
    )
    rows = df.withColumns({f"_r_{m}": earlier(over_rows, m) for m in measures})
    rows = rows.join(cells, [group, "_cell"])
    kept = [c for c in df.columns if c != "_cell"]
    return rows.select(*kept, *[(F.col(f"_b_{m}") + F.col(f"_r_{m}")).alias(name) for m, name in measures.items()])


def repeated(rows: DataFrame, count: str, *keys: str) -> DataFrame:
    """A row for each number from 0 below ``count``, as ``_i``; long counts are dealt out in chunks."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(CHUNK).cast("long")))
    many = F.col(count) > CHUNK
    parts = rows.filter(many).withColumn("_first", first).repartition(*keys, "_first")
    parts = parts.unionByName(rows.filter(~many & (F.col(count) > 0)).withColumn("_first", F.lit(0).cast("long")))
    last = F.least(F.col("_first") + CHUNK, F.col(count)) - 1
    return parts.withColumn("_i", F.explode(F.sequence(F.col("_first"), last))).drop("_first")


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """The rows dealt to partitions by ranges of a total order, written, with the partition's number as ``_part``."""
    return checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def ordered_totals(df: DataFrame, order: list[Column], measures: dict[str, str]) -> DataFrame:
    """Add for each measure its sum over all rows before this one; df comes from :func:`ranged` by the same order.

    The one window without a partition goes over a row for each partition.
    """
    before = (Window.unboundedPreceding, -1)
    over_parts = Window.orderBy("_part").rowsBetween(*before)
    over_rows = Window.partitionBy("_part").orderBy(*order).rowsBetween(*before)
    zero = F.lit(0).cast("long")
    parts = df.groupBy("_part").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_s_{m}").over(over_parts), zero).alias(f"_b_{m}") for m in measures])
    rows = df.withColumns({f"_r_{m}": F.coalesce(F.sum(m).over(over_rows), zero) for m in measures})
    rows = rows.join(F.broadcast(parts), "_part")  # as many rows as there are partitions
    return rows.select(*df.columns, *[(F.col(f"_b_{m}") + F.col(f"_r_{m}")).alias(name) for m, name in measures.items()])


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns; those that can't be hashed themselves, as maps, are hashed as JSON."""

    def plain(field) -> Column:
        column = F.col(f"`{field.name}`")
        return F.to_json(F.struct(column.alias("c"))) if "map<" in field.dataType.simpleString() else column

    return F.xxhash64(F.lit(seed), *[plain(f) for f in df.schema.fields])


def join_totals(rows: DataFrame, totals: DataFrame, key: str, count: str, number: int) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose ``count`` says how many of the ``number`` rows have the key.

    Keys with more than a part in ``HOT_PARTS`` of the rows, fewer than HOT_PARTS therefore, are joined by broadcast, so
    that no task gets all rows of one; the others by a shuffle.
    """
    names = [c for c in totals.columns if c not in (key, count)]
    limit = F.lit(number / HOT_PARTS)
    hot = totals.filter(F.col(count) > limit).select(key, F.struct(*names).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    first = marked.filter(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col("_hot").getField(n).alias(n) for n in names])
    rest = marked.filter(F.col("_hot").isNull()).select(*rows.columns)
    return first.unionByName(rest.join(totals.filter(F.col(count) <= limit).select(key, *names), key).select(*rows.columns, *names))
