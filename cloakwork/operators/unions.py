"""Overlapping boxes as one, for pages with any number of boxes.

Windows cut a page into islands first: sorted by one side, a box that begins where all before it have ended begins a new
island, by columns, then by rows within columns, then by columns again.  Boxes of different islands can't overlap, nor can what they
become.  What is left in an island is swept once for each time that something grew: the boxes that are open at a place
don't overlap, so they are in order and a new one meets a run of them.  The result is the only one
possible, however the boxes are ordered: in the end each box lies in one that overlaps no other.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import dealt

_SIDES = ("x1", "y1", "x2", "y2")


def _swept(boxes: list[tuple]) -> list[tuple]:
    """One sweep from left to right; boxes that meet are one from there on."""
    done: list[tuple] = []
    tops: list[float] = []  # of the open boxes, in order; none overlaps another from top to bottom
    open_: list[tuple] = []
    bottoms: list[float] = []
    for box in sorted(boxes):
        here, now = box[0], box
        while True:
            low, high = bisect_right(bottoms, now[1]), bisect_left(tops, now[3])
            if low >= high:
                break
            met = [b for b in open_[low:high] if b[2] > here]
            done += [b for b in open_[low:high] if b[2] <= here]
            del tops[low:high], open_[low:high], bottoms[low:high]
            if met:
                now = (min(now[0], *(b[0] for b in met)), min(now[1], *(b[1] for b in met)), max(now[2], *(b[2] for b in met)), max(now[3], *(b[3] for b in met)))
        at = bisect_left(tops, now[1])
        tops.insert(at, now[1])
        open_.insert(at, now)
        bottoms.insert(at, now[3])
    return done + open_


def united(boxes: list[tuple]) -> list[tuple]:
    """(x1, y1, x2, y2) of the boxes after those that strictly overlap have become one, until none do."""
    while True:
        after = _swept(boxes)
        if len(after) == len(boxes):
            return sorted(after)
        boxes = after


def _islands(rows: DataFrame, within: list[str], low: str, high: str, name: str) -> DataFrame:
    ordered = Window.partitionBy(*within).orderBy(low, high)
    before = F.max(high).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(low) >= before), 1).otherwise(0)
    running = F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_new", new).withColumn(name, running).drop("_new")


def unite_boxes(rows: DataFrame, page: str) -> DataFrame:
    """(page, x1, y1, x2, y2) of the united boxes of each page; boxes that lack a side or have no area are left out.

    A page's boxes are shuffled once, to partitions whose number grows with the input, and sorted; a task holds the boxes of one island, 32 bytes each.
    """
    boxes = rows.select(F.col(page).alias("_page"), *[F.col(s).cast("double").alias(s) for s in _SIDES])
    boxes = dealt(boxes.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))), "_page")
    keys = ["_page"]
    for n, (low, high) in enumerate((("x1", "x2"), ("y1", "y2"), ("x1", "x2"))):
        boxes = _islands(boxes, keys, low, high, f"_in{n}")
        keys = [*keys, f"_in{n}"]

    def unite(key: tuple[pa.Scalar, ...], island: pa.Table) -> pa.Table:
        made = united(list(zip(*(island.column(s).to_pylist() for s in _SIDES))))
        sides = np.array(made, np.float64).T
        return pa.table({"page": pa.array([key[0].as_py()] * len(made), island.schema.field("_page").type)} | {s: pa.array(v) for s, v in zip(_SIDES, sides)})

    kind = T.StructType([T.StructField("page", boxes.schema["_page"].dataType), *[T.StructField(s, T.DoubleType()) for s in _SIDES]])
    return boxes.groupBy(*keys).applyInArrow(unite, kind).withColumnRenamed("page", page)
