"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of points.  Each shard owns virtual nodes at hashed
points, a key belongs to the first virtual node at or after its own point, and a
shard never takes more than its bound: keys over it continue clockwise to the
next shard with room.  With no slack the bounds are the row counts themselves,
so the shards' counts are at most one apart; with slack fewer keys move when
a shard is added.

Only counts per ring point reach the driver: at most RING_POINTS rows at any
input size.  They give the plan, ranges of ranks within a point for each shard.
Rows are ranked within their point by a hash of the whole row, so one shuffle
by point places them, and the plan, at most a row for each point and shard, is sent to all.  A key that many
rows share has one point: points with more than one in ``HOT_PARTS`` rows are cut into cells by
the hash, rows alike in all columns are one row with a count until they have their ranks, and
the cells' counts, again at most a few thousand, place the cells in their point.

Cases: a null key is a key of its own, a null text has no bytes; rows that are
the same in all columns get different slots; an empty table gives an empty
result; texts are measured whole; further columns, maps too, are kept by :func:`shard`, whose ``shard`` and ``slot`` take the place of any of their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CELL_ROWS, HOT_PARTS, packed, repeated, row_hash, unpacked

RING_POINTS = 1 << 16
VIRTUAL_NODES = 128
N_SHARDS = 24


def _point(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(RING_POINTS)).cast("int")


def ring_nodes(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes in ring order; a shard's nodes don't depend on how many shards there are."""
    nodes = (
        spark.range(shards)
        .select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))).alias("node"))
        .select(_point(F.lit("node"), "shard", "node").alias("point"), "shard")
    )
    return sorted((r["point"], r["shard"]) for r in nodes.collect())


def plan_ring(
    counts: dict[int, int], nodes: list[tuple[int, int]], bounds: list[int]
) -> list[tuple[int, int, int, int, int]]:
    """(point, first rank, end rank, shard, first slot): where the rows of each point go.

    In each round every point offers its unplaced rows to the next shard
    clockwise that it hasn't tried, in ring order, and the shard takes what it has room for.
    """
    room, used = list(bounds), [0] * len(bounds)
    points = [p for p, _ in nodes]
    plan = []
    waiting = [(point, 0, counts[point], bisect_left(points, point)) for point in sorted(counts)]
    tried: dict[int, set[int]] = defaultdict(set)
    while waiting:
        over = []
        for point, first, end, at in waiting:
            shard = nodes[at % len(nodes)][1]
            if taken := min(room[shard], end - first):
                plan.append((point, first, first + taken, shard, used[shard]))
                room[shard] -= taken
                used[shard] += taken
            if first + taken < end:
                seen = tried[point]
                seen.add(shard)
                if len(seen) == len(bounds):
                    raise ValueError("the bounds have no room for all rows")
                while nodes[at % len(nodes)][1] in seen:
                    at += 1
                over.append((point, first + taken, end, at))
        waiting = over
    return plan


def load_bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many rows each shard may take: the mean, rounded so that the sum is right, or more by the slack."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _ranked(keyed: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(_point, _rank, _row) of all rows; ranks count from 0 within a point, by the hashes of the whole row."""
    spark = keyed.sparkSession
    limit = max(CELL_ROWS, sum(counts.values()) / HOT_PARTS)
    hot = {point: math.ceil(n / limit) for point, n in counts.items() if n > limit}
    by_point = Window.partitionBy("_point").orderBy("_mark", "_check")
    plain = keyed.filter(~F.col("_point").isin(list(hot))) if hot else keyed
    ranked = plain.select("_point", (F.row_number().over(by_point) - 1).cast("long").alias("_rank"), "_row")
    if not hot:
        return ranked
    cells = spark.createDataFrame(list(hot.items()), "_point int, _cells int")
    cell = F.pmod(F.xxhash64("_mark", F.lit("cell")), F.col("_cells")).cast("int")
    rows = keyed.join(F.broadcast(cells), "_point").withColumn("_cell", cell)  # at most HOT_PARTS points
    sizes = {(r["_point"], r["_cell"]): r["count"] for r in rows.groupBy("_point", "_cell").count().collect()}
    starts = []
    for point in hot:
        here = sorted(c for p, c in sizes if p == point)
        before = accumulate((sizes[point, c] for c in here), initial=0)
        starts += [(point, c, start) for c, start in zip(here, before, strict=False)]
    offsets = spark.createDataFrame(starts, "_point int, _cell int, _offset long")
    alike = rows.groupBy("_point", "_cell", "_mark", "_check").agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_point", "_cell").orderBy("_mark", "_check").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(F.broadcast(offsets), ["_point", "_cell"])
    each = repeated(alike, "_n", "_point", "_cell", "_mark")
    return ranked.unionByName(each.select("_point", (F.col("_offset") + F.col("_before") + F.col("_i")).alias("_rank"), "_row"))


def shard(
    docs: DataFrame,
    shards: int = N_SHARDS,
    key: str = "doc_id",
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = 0.0,
) -> DataFrame:
    """All rows of docs with ``shard`` and ``slot``, gapless from 0 within a shard."""
    spark = docs.sparkSession
    point = _point(F.lit("key"), row_hash(docs.select(F.col(f"`{key}`"))))
    keyed = packed(docs, _point=point, _mark=row_hash(docs), _check=row_hash(docs, 1))
    counts = {r["_point"]: r["count"] for r in keyed.groupBy("_point").count().collect()}
    plan = plan_ring(
        counts, ring_nodes(spark, shards, virtual_nodes), load_bounds(sum(counts.values()), shards, slack)
    )
    ranges = spark.createDataFrame(plan, "_point int, _first long, _end long, _shard int, _slot long")
    # A range of the plan ends a point or fills a shard, so there are at most RING_POINTS + shards of them.
    placed = _ranked(keyed, counts).join(F.broadcast(ranges), "_point").filter("_rank >= _first and _rank < _end")
    return unpacked(placed, docs.columns, shard=F.col("_shard"), slot=F.col("_slot") + F.col("_rank") - F.col("_first"))


def shard_report(docs: DataFrame, shards: int = N_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard(rows, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
