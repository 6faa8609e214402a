"""Private text as rectangles of a page: spans joined to the boxes of the text runs that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import with_once
from ..sources.tables import PAGE_PART, dealt
from .spans import scan_text

# Budgets of a page, elements whose whole block is masked for an address, the largest share of the view it may have.
MAX_VISITED, MAX_INSPECTED, MAX_REGIONS = 20_000, 1_600, 160
BLOCKS = ("p", "li", "dd", "address")
LARGEST_BLOCK = 0.25
_BOX = ("x", "y", "width", "height")


def _cut(run: Column, start: Column, end: Column) -> Column:
    """A run's box, cut to the offsets in proportion."""
    size = run["end"] - run["start"]
    low, high = F.greatest(start, run["start"]) - run["start"], F.least(end, run["end"]) - run["start"]
    return F.struct((run["x"] + run["width"] * low / size).alias("x"), run["y"].alias("y"), (run["width"] * (high - low) / size).alias("width"), run["height"].alias("height"))


def inspected_texts(nodes: DataFrame) -> DataFrame:
    """The texts of scoped nodes that a scan looks at, within its budgets; ``over`` marks a page whose budget doesn't do.

    Texts are visited scope by scope; those that are blank or not shown count as visited only.
    """
    texts = nodes.select("page_id", "scope_place", "scope", "node", "tag", "shown", F.explode("texts").alias("t"))
    order = Window.partitionBy("page_id").orderBy("scope_place", "t.place")
    looked_at = F.col("shown") & (F.trim("t.text") != "")
    budget = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = texts.withColumns({"visited": F.row_number().over(order), "inspected": F.sum(looked_at.cast("int")).over(budget)})
    within = (F.col("visited") <= MAX_VISITED) & (F.col("inspected") <= MAX_INSPECTED)
    first_over = counted.filter(looked_at & within | (~within & ((F.col("visited") == MAX_VISITED + 1) | looked_at & (F.col("inspected") == MAX_INSPECTED + 1))))
    return first_over.select("page_id", "scope_place", "scope", "node", "tag", F.col("t.place").alias("place"), F.col("t.text").alias("text"), (~within).alias("over"))


def text_regions(nodes: DataFrame, runs: DataFrame, view_width: float, view_height: float, strict: bool = False) -> DataFrame:
    """(page_id, x, y, width, height, kind): boxes of the private spans in a page's texts, 160 at most.

    ``nodes`` are scoped; ``runs`` are the boxes of texts as laid out: (page_id, node, place, start, end, x, y, width, height),
    of code points start to end of the text at that place, which a node holds.  A span in a frame masks the node's
    whole block for each of its boxes.  With ``strict`` an address masks its small block, a span
    without a box the node's block, and a page that exceeds a budget or leaves a span without any box has one row, of kind BLOCKED.
    """
    runs = runs.filter(F.col("end") > F.col("start"))
    texts = inspected_texts(nodes)
    found = F.transform(scan_text(F.col("text")), lambda s: F.struct(s["index"].alias("start"), (s["index"] + s["length"]).alias("end"), F.upper(s["kind"]).alias("kind")))
    read = with_once(texts, "found", F.when(~F.col("over"), found)).filter("over or size(found) > 0")
    text = F.struct("scope_place", "scope", "tag", "over", "found").alias("text")
    run = F.struct("start", "end", *[F.col(c).cast("double").alias(c) for c in _BOX]).alias("run")
    sides = read.select("page_id", "node", "place", text).unionByName(runs.select("page_id", "node", "place", run), allowMissingColumns=True)
    # A text meets its own runs in one row; what a row holds is of one text, and all of a page is in one partition for what follows.
    right, bottom = F.max(F.col("run.x") + F.col("run.width")), F.max(F.col("run.y") + F.col("run.height"))
    met = dealt(sides, "page_id", part=PAGE_PART).groupBy("page_id", "node", "place").agg(
        F.first("text", ignorenulls=True).alias("text"), F.collect_list("run").alias("runs"), F.min("run.x").alias("x"), F.min("run.y").alias("y"), right.alias("r"), bottom.alias("b"),
    )
    node = Window.partitionBy("page_id", "node")
    sides_of = {"x": F.min("x").over(node), "y": F.min("y").over(node), "r": F.max("r").over(node), "b": F.max("b").over(node)}
    met = met.withColumns(sides_of).filter("text is not null")
    block = F.when(F.col("x").isNotNull(), F.struct("x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("b") - F.col("y")).alias("height")))
    met = met.select("page_id", "place", "text", "runs", block.alias("block"))
    entry = lambda s, run, box: F.struct(F.struct(s["start"].alias("start"), s["end"].alias("end")).alias("s"), s["kind"].alias("kind"), run.cast("long").alias("run"), box.alias("box"))

    def boxes(s: Column) -> Column:
        hit = F.filter("runs", lambda r: (s["start"] < r["end"]) & (r["start"] < s["end"]))
        cuts = F.filter(F.transform(hit, lambda r: F.struct(r["start"].alias("run"), _cut(r, s["start"], s["end"]).alias("cut"))), lambda c: (c["cut"]["width"] > 1) & (c["cut"]["height"] > 1))
        touched = F.transform(cuts, lambda c: entry(s, c["run"], F.when(F.col("text.scope").contains("/frame"), F.col("block")).otherwise(c["cut"])))
        if not strict:
            return touched
        bare = F.array(entry(s, F.lit(0), F.col("block")))
        return F.when((s["kind"] == "ADDRESS") & F.col("text.tag").isin(*BLOCKS) | (F.size(cuts) == 0), bare).otherwise(touched)

    late = entry(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("kind")), F.lit(0), F.lit(None).cast("struct<x:double,y:double,width:double,height:double>"))
    every = met.filter(F.lit(strict) | ~F.col("text.over")).select(
        "page_id", "text.scope_place", "place", F.col("text.over").alias("over"), F.explode(F.when(F.col("text.over"), F.array(late)).otherwise(F.flatten(F.transform("text.found", boxes)))).alias("e"),
    ).select("page_id", "scope_place", "place", "over", "e.*")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("over", "scope_place", "place", "s", "kind", "run"))
    if not strict:
        return every.withColumn("n", place).filter(F.col("n") <= MAX_REGIONS).select("page_id", *[F.col(f"box.{c}").alias(c) for c in _BOX], "kind")
    # A page over its budget has rows of its own here, so that one pass by page sees everything about it.
    ranked = every.withColumn("n", F.when(F.col("over"), 0).otherwise(place))
    area = F.col("box.width") * F.col("box.height")
    is_block = (F.col("kind") == "ADDRESS") & (area > LARGEST_BLOCK * view_width * view_height)
    bad = F.col("over") | F.col("box").isNull() | (F.col("box.width") <= 0) | (F.col("box.height") <= 0) | is_block | (F.col("n") > MAX_REGIONS)
    over = Window.partitionBy("page_id")
    rows = ranked.select("page_id", bad.alias("bad"), "kind", *[F.col(f"box.{c}").alias(c) for c in _BOX], "n")
    marked = rows.withColumns({"blocked": F.max("bad").over(over), "one": F.row_number().over(over.orderBy(F.desc("bad"), "n"))})
    shown = lambda c: F.when(~F.col("blocked"), F.col(c)).alias(c)
    return marked.filter(~F.col("blocked") | (F.col("one") == 1)).select("page_id", *[shown(c) for c in _BOX], F.when(F.col("blocked"), "BLOCKED").otherwise(F.col("kind")).alias("kind"))
