"""Boxes: overlap, suppression, mapping, runs, unions and coverage.

A box is a struct (x, y, width, height), a corner box (x1, y1, x2, y2).  Work on
the boxes of one page is done on that page's array, so nothing is shuffled
beyond what brings a page's boxes together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up, let
from .spans import spans_of

# Bounds of sources and of the scale between page and capture.
MAX_SIDE, MAX_PIXELS = 100_000, 12_000_000
MAX_ASPECT, MAX_DENSITY = 1.02, 1.1
CORNERS = "struct<x1:double,y1:double,x2:double,y2:double>"


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def to_corners(box: Column) -> Column:
    return corners(box["x"], box["y"], box["x"] + box["width"], box["y"] + box["height"])


def intersection(a: Column, b: Column) -> Column:
    """Area that two corner boxes share."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w * h


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a["x2"] - a["x1"]) * F.greatest(F.lit(0.0), a["y2"] - a["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of corner boxes; 0 if the union is empty."""
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    """The same for (x, y, width, height), 0 if a box isn't finite and positive."""
    ok = lambda r: (
        finite(r["x"]) & finite(r["y"]) & finite(r["width"]) & finite(r["height"]) & (r["width"] > 0) & (r["height"] > 0)
    )
    return F.when(ok(a) & ok(b), iou(to_corners(a), to_corners(b))).otherwise(F.lit(0.0))


def overlap_of_areas(shared: Column, one: Column, other: Column) -> Column:
    """The same from the shared area and the two whole ones."""
    return F.when(one + other > shared, shared / (one + other - shared)).otherwise(F.lit(0.0))


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Shared area over the smaller area, at least 1."""
    return intersection(a, b) / F.greatest(F.lit(1.0), F.least(area(a), area(b)))


def suppress(boxes: Column, threshold: float = 0.3, limit: int = 30, inclusive: bool = True) -> Column:
    """Greedy suppression of an array of structs with ``score`` and corners: best score first, ties by order.

    A box stays if its overlap with every box kept so far is at most the threshold, up to the limit.
    """
    keyed = F.sort_array(F.transform(boxes, lambda b, i: F.struct((-b["score"]).alias("k"), i.alias("i"), b.alias("b"))))
    empty = F.filter(F.transform(keyed, lambda x: x["b"]), lambda b: F.lit(False))
    step = lambda kept, x: F.when(
        (F.size(kept) < limit) & ~F.exists(kept, lambda k: iou(k, x["b"]) > threshold), F.concat(kept, F.array(x["b"]))
    ).otherwise(kept)
    return F.aggregate(keyed, empty, step)


def capture_scale(width: Column, height: Column, view_width: Column, view_height: Column, density: Column) -> Column:
    """(safe, scale_x, scale_y): whether a capture fits its viewport."""
    sx, sy = width / view_width, height / view_height
    ok = (
        finite(view_width) & finite(view_height) & finite(density) & (view_width > 0) & (view_height > 0)
        & (view_width <= MAX_SIDE) & (view_height <= MAX_SIDE) & density.between(0.01, 100)
        & (F.greatest(sx, sy) / F.least(sx, sy) <= MAX_ASPECT) & (F.greatest(sx, density) / F.least(sx, density) <= MAX_DENSITY)
        & sx.between(0.1, 100)
    )
    safe = F.coalesce(ok, F.lit(False))
    return F.struct(safe.alias("safe"), F.when(safe, sx).alias("scale_x"), F.when(safe, sy).alias("scale_y"))


def clip(value: Column, low, high) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(high, F.greatest(low, value))


def map_box(box: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    """A page box in pixels of the capture, clipped to it; null if the geometry is invalid."""
    ok = (
        finite(sx) & finite(sy) & (sx > 0) & (sy > 0) & finite(box["x"]) & finite(box["y"]) & finite(box["width"])
        & finite(box["height"]) & (box["width"] > 0) & (box["height"] > 0)
    )
    return F.when(
        ok,
        corners(
            clip(box["x"] * sx, 0.0, width), clip(box["y"] * sy, 0.0, height),
            clip((box["x"] + box["width"]) * sx, 0.0, width), clip((box["y"] + box["height"]) * sy, 0.0, height),
        ),
    )


def map_surface(box: Column, surface: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    """A box on an image or canvas in pixels of the capture, by how the image fits its place; null if nothing is left."""
    place, iw, ih = surface["rect"], surface["intrinsic_width"], surface["intrinsic_height"]
    contain = F.least(place["width"] / iw, place["height"] / ih)
    cover = F.greatest(place["width"] / iw, place["height"] / ih)
    fit = surface["object_fit"]
    factor = F.when(fit == "contain", contain).when(fit == "cover", cover).when(fit == "scale-down", F.least(F.lit(1.0), contain)).otherwise(F.lit(1.0))
    shown_w = F.when(fit == "fill", place["width"]).otherwise(iw * factor)
    shown_h = F.when(fit == "fill", place["height"]).otherwise(ih * factor)
    left = place["x"] + (place["width"] - shown_w) * surface["position_x"]
    top = place["y"] + (place["height"] - shown_h) * surface["position_y"]
    x = lambda v: clip(clip(left + v * shown_w / iw, place["x"], place["x"] + place["width"]) * sx, 0.0, width)
    y = lambda v: clip(clip(top + v * shown_h / ih, place["y"], place["y"] + place["height"]) * sy, 0.0, height)
    ok = fit.isin("fill", "contain", "cover", "none", "scale-down") & (iw > 0) & (ih > 0) & (place["width"] > 0) & (place["height"] > 0)
    ok &= surface["position_x"].between(0, 1) & surface["position_y"].between(0, 1)
    mapped = corners(x(box["x1"]), y(box["y1"]), x(box["x2"]), y(box["y2"]))
    return let(mapped, lambda m: F.when(ok & (m["x2"] > m["x1"]) & (m["y2"] > m["y1"]), m))


def bounding(boxes: Column) -> Column:
    """The smallest corner box around an array of corner boxes."""
    side = lambda n, f: f(F.transform(boxes, lambda b: b[n]))
    return corners(side("x1", F.array_min), side("y1", F.array_min), side("x2", F.array_max), side("y2", F.array_max))


def union_boxes(boxes: Column) -> Column:
    """Overlapping boxes as one, again and again until none overlap strictly; in order of first appearance of the last part."""

    def touch(a: Column, b: Column) -> Column:
        return (a["x1"] < b["x2"]) & (a["x2"] > b["x1"]) & (a["y1"] < b["y2"]) & (a["y2"] > b["y1"])

    def absorb(state: Column, _: Column) -> Column:
        """Take every box that the current one overlaps into it."""
        hit = F.filter(state["rest"], lambda r: touch(state["now"], r))
        return F.when(F.size(hit) == 0, state).otherwise(
            F.struct(
                bounding(F.concat(F.array(state["now"]), hit)).alias("now"),
                F.filter(state["rest"], lambda r: ~touch(state["now"], r)).alias("rest"),
            )
        )

    def step(merged: Column, box: Column) -> Column:
        first = F.struct(box.cast(CORNERS).alias("now"), merged.alias("rest"))
        rounds = F.sequence(F.lit(0), F.size(merged))
        alone = F.concat(merged, F.array(box.cast(CORNERS)))
        return F.when(~F.exists(merged, lambda m: touch(box, m)), alone).otherwise(F.aggregate(rounds, first, absorb, lambda s: F.concat(s["rest"], F.array(s["now"]))))

    kind = f"array<{CORNERS}>"
    return let(boxes, lambda b: F.when(F.size(b) < 2, b.cast(kind)).otherwise(F.aggregate(b, F.expr(f"cast(array() as {kind})"), step)))


def split_runs(words: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """Words (x1, y1, x2, y2) of a row with ``run``: a new one begins where the gap to the rightmost edge so far is wide.

    The gap that joins is three quarters of the taller of the two words, between 12 and 32.
    """
    ordered = Window.partitionBy(*page).orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.max(F.struct("x2", (F.col("y2") - F.col("y1")).alias("h"))).over(before)
    join = F.greatest(F.lit(12.0), F.least(F.lit(32.0), F.ceil(F.greatest(F.col("_edge.h"), F.col("y2") - F.col("y1")) * 0.75)))
    # The running maximum may belong to an earlier run; a run's own edge is right of it only after a new run began,
    # and a word left of an earlier edge joins by either rule.
    new = F.when(F.col("_edge").isNull(), 0).when(F.col("x1") - F.col("_edge.x2") > join, 1).otherwise(0)
    return words.withColumn("_edge", edge).withColumn("run", F.sum(new).over(ordered)).drop("_edge")


def group_rows(words: Column) -> Column:
    """Rows of an array of words (text, confidence, box with corners), each with top, bottom, centre and its words.

    Words by middle and left edge; a word joins the first row that it overlaps by 45 per cent of the lower
    height and whose centre is within 60 per cent of the greater height.
    """
    # A fold copies what it carries at each step, so that words are carried as numbers.
    mid = lambda w: w["box"]["y1"] + w["box"]["y2"]
    keyed = F.sort_array(F.transform(words, lambda w, i: F.struct(
        mid(w).cast("double").alias("m"), w["box"]["x1"].cast("double").alias("x"), i.alias("i"), w["box"]["y1"].cast("double").alias("top"), w["box"]["y2"].cast("double").alias("bottom"))))
    row_type = "struct<top:double,bottom:double,centre:double,words:array<struct<x1:double,y1:double,i:int>>>"
    entry = lambda x: F.struct(x["x"].alias("x1"), x["top"].alias("y1"), x["i"].alias("i"))

    def fits(r: Column, x: Column) -> Column:
        overlap = F.least(x["bottom"], r["bottom"]) - F.greatest(x["top"], r["top"])
        height, tall = x["bottom"] - x["top"], r["bottom"] - r["top"]
        return (overlap >= F.least(height, tall) * 0.45) & (F.abs(x["m"] / 2 - r["centre"]) <= F.greatest(height, tall) * 0.6)

    def grown(r: Column, x: Column) -> Column:
        top, bottom = F.least(r["top"], x["top"]), F.greatest(r["bottom"], x["bottom"])
        return F.struct(top.alias("top"), bottom.alias("bottom"), ((top + bottom) / 2).alias("centre"), F.concat(r["words"], F.array(entry(x))).alias("words"))

    def step(rows: Column, x: Column) -> Column:
        one = F.struct(x["top"].alias("top"), x["bottom"].alias("bottom"), (x["m"] / 2).alias("centre"), F.array(entry(x)).alias("words"))
        return let(
            F.array_position(F.transform(rows, lambda r: fits(r, x)), True),
            lambda at: F.when(at == 0, F.concat(rows, F.array(one))).otherwise(F.transform(rows, lambda r, i: F.when(i == at - 1, grown(r, x)).otherwise(r))),
        )

    def word(e: Column) -> Column:
        w = words[e["i"]]
        return F.struct(w["text"].alias("text"), w["confidence"].alias("confidence"), w["box"].cast(CORNERS).alias("box"))

    rows = F.aggregate(keyed, F.expr(f"cast(array() as array<{row_type}>)"), step)
    return F.transform(
        rows,
        lambda r: F.struct(r["top"].alias("top"), r["bottom"].alias("bottom"), r["centre"].alias("centre"), F.transform(F.sort_array(r["words"]), word).alias("words")),
    )


def runs_of(words: Column) -> Column:
    """An ordered array of words cut into runs, as :func:`split_runs` does for rows."""
    # The places where runs begin, and right edge and height of the rightmost word of the last one.
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"), F.lit(0.0).alias("x2"), F.lit(0.0).alias("h"))

    def step(acc: Column, w: Column) -> Column:
        height, right = (w["box"]["y2"] - w["box"]["y1"]).cast("double"), w["box"]["x2"].cast("double")
        gap = F.greatest(F.lit(12.0), F.least(F.lit(32.0), F.ceil(F.greatest(acc["h"], height) * 0.75)))
        after = (acc["at"] + 1).alias("at")
        begun = F.struct(after, F.concat(acc["starts"], F.array(acc["at"])).alias("starts"), right.alias("x2"), height.alias("h"))
        further = F.struct(after, acc["starts"].alias("starts"), right.alias("x2"), height.alias("h"))
        within = F.struct(after, acc["starts"].alias("starts"), acc["x2"].alias("x2"), acc["h"].alias("h"))
        return F.when((acc["at"] == 0) | (w["box"]["x1"] - acc["x2"] > gap), begun).when(right > acc["x2"], further).otherwise(within)

    starts = F.aggregate(words, first, step, lambda acc: acc["starts"])
    cut = let(starts, lambda s: F.transform(s, lambda at, i: F.slice(words, at + 1, F.coalesce(F.get(s, i + 1), F.size(words)) - at)))
    return F.when(F.size(words) == 1, F.array(words)).otherwise(cut)


def scan_run(words: Column, separator: str | Column) -> Column:
    """Boxes of the spans in the words joined by the separator: each span's box is around the words that it touches."""
    separator = F.lit(separator) if isinstance(separator, str) else separator

    def place(acc: Column, w: Column) -> Column:
        start = F.when(F.size(acc) == 0, F.lit(0)).otherwise(F.element_at(acc, -1)["stop"] + F.length(separator))
        one = F.struct(start.cast("int").alias("start"), (start + F.length(w["text"])).cast("int").alias("stop"), w["box"].cast(CORNERS).alias("box"))
        return F.concat(acc, F.array(one))

    places = F.aggregate(words, F.expr(f"cast(array() as array<struct<start:int,stop:int,box:{CORNERS}>>)"), place)
    # array_join() takes constants only as its separator.
    joined = F.concat_ws("", F.transform(words, lambda w, i: F.concat(F.when(i > 0, separator).otherwise(""), w["text"])))
    # Of a single word each span touches that word.
    alone = F.size(words) == 1
    text = F.when(alone, F.coalesce(words[0]["text"], F.lit(""))).otherwise(joined)

    def around(spans: Column) -> Column:
        boxes = lambda p: F.transform(spans, lambda s: bounding(F.transform(F.filter(p, lambda o: (s["start"] < o["stop"]) & (s["end"] > o["start"])), lambda o: o["box"])))
        none = F.expr(f"cast(array() as array<{CORNERS}>)")
        return F.when(F.size(spans) == 0, none).when(alone, F.transform(spans, lambda s: words[0]["box"].cast(CORNERS))).otherwise(let(places, boxes))

    return let(let(text, spans_of), around)


def review_words(words: Column, width: Column, height: Column, least: float = 40.0, most: int = 600) -> Column:
    """(full, regions): what to mask of the recognised words of a page.

    A run with an uncertain word or one that isn't plain ASCII is masked as a whole; other runs are scanned with and
    without spaces.  Invalid words or sizes mask everything.
    """
    ok = lambda w: (
        w["text"].isNotNull() & (F.trim(w["text"]) != "") & (F.length(w["text"]) <= 128) & w["confidence"].between(0, 100)
        & (w["box"]["x1"] >= 0) & (w["box"]["y1"] >= 0) & (w["box"]["x2"] <= width) & (w["box"]["y2"] <= height)
        & (w["box"]["x2"] > w["box"]["x1"]) & (w["box"]["y2"] > w["box"]["y1"])
    )
    valid = (
        (F.size(words) > 0) & (F.size(words) <= most) & (width > 0) & (height > 0) & (width * height <= MAX_PIXELS)
        & F.forall(words, lambda w: F.coalesce(ok(w), F.lit(False)))
    )
    sure = lambda w: (w["confidence"] >= least) & w["text"].rlike(r"^[\x20-\x7e]+\z")
    box = lambda w: w["box"].cast(CORNERS)
    # The detectors are written once and applied to each joined form: of a single word both forms are alike.
    forms = lambda run: F.slice(F.array(F.lit(" "), F.lit("")), F.lit(1), F.least(F.lit(2), F.size(run)))
    masks = lambda run: F.when(F.exists(run, lambda w: ~sure(w)), F.array(bounding(F.transform(run, box)))).otherwise(
        F.flatten(F.transform(forms(run), lambda s: scan_run(run, s)))
    )
    regions = union_boxes(F.flatten(F.flatten(F.transform(group_rows(words), lambda r: F.transform(runs_of(r["words"]), masks)))))
    none = F.expr(f"cast(array() as array<{CORNERS}>)")
    return let(F.coalesce(valid, F.lit(False)), lambda v: F.struct((~v).alias("full"), F.when(v, regions).otherwise(none).alias("regions")))


def plan_masks(words: Column, space: Column, surface: Column, scale: Column, width: Column, height: Column) -> Column:
    """:func:`review_words` for words on the capture or, mapped to it, on an image; an unknown space masks everything."""
    mapped = F.transform(
        words,
        lambda w: F.struct(
            w["text"].alias("text"), w["confidence"].alias("confidence"),
            map_surface(w["box"].cast(CORNERS), surface, scale["scale_x"], scale["scale_y"], width, height).alias("box"),
        ),
    )
    on_image = space.isin("image", "canvas", "raster")
    known = space.isNull() | (space == "screenshot") | (on_image & scale["safe"])
    everything = F.struct(F.lit(True).alias("full"), F.expr(f"cast(array() as array<{CORNERS}>)").alias("regions"))
    chosen = F.when(on_image, mapped).otherwise(words)
    return F.when(known, let(chosen, lambda w: review_words(w, width, height))).otherwise(everything)


def covered(latest: Column, prior: Column) -> Column:
    """Whether every box of ``latest`` lies inside one of ``prior``."""
    inside = lambda n, p: (
        (n["x"] >= p["x"]) & (n["y"] >= p["y"]) & (n["x"] + n["width"] <= p["x"] + p["width"]) & (n["y"] + n["height"] <= p["y"] + p["height"])
    )
    return F.forall(latest, lambda n: F.exists(prior, lambda p: inside(n, p)))


def fuse_detections(detections: DataFrame, controls: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """(page, ok, matched, regions): each detection must overlap exactly one control, and no control twice.

    Detections and controls are joined by page with the overlap as a condition; regions enlarge sensitive controls.
    """
    d, c = detections.alias("d"), controls.alias("c")
    joined = d.join(c, (F.col(f"d.{page}") == F.col(f"c.{page}")) & (iou(F.col("c.box"), F.col("d.box")) >= least), "left")
    per = joined.groupBy(F.col(f"d.{page}").alias(page), F.col("d.detection").alias("detection")).agg(
        F.count("c.ref").alias("n"),
        F.min("c.ref").alias("ref"),
        F.min(F.when(F.col("c.sensitive"), F.struct(bounding(F.array("c.box", "d.box")).alias("box")))).alias("region"),
    )
    by_page = per.groupBy(page).agg(
        (F.min(F.when(F.col("n") == 1, 1).otherwise(0)) == 1).alias("single"),
        (F.count_distinct("ref") == F.count("ref")).alias("once"),
        F.sort_array(F.collect_list("ref")).alias("refs"),
        F.sort_array(F.collect_list(F.col("region.box"))).alias("boxes"),
    )
    ok = F.col("single") & F.col("once")
    return by_page.select(
        page, ok.alias("ok"), F.when(ok, F.col("refs")).otherwise(F.slice("refs", 1, 0)).alias("matched"),
        F.when(ok, F.col("boxes")).otherwise(F.slice("boxes", 1, 0)).alias("regions"),
    )


def fuse_sources(dom: Column, ocr: Column, vision: Column, least: float = 0.45) -> Column:
    """Elements (ref, text, confidence, source, box) of three sources as one array; a match raises the confidence."""
    first = lambda xs, e: F.try_element_at(F.filter(xs, lambda x: box_iou(e["box"], x["box"]) >= least), F.lit(1))
    blank = lambda t: F.when(t != "", t)

    def fused(e: Column) -> Column:
        return let(
            F.struct(first(ocr, e).alias("o"), first(vision, e).alias("v")),
            lambda m: F.when(m["o"].isNull() & m["v"].isNull(), e).otherwise(
                F.struct(
                    e["ref"].alias("ref"),
                    F.coalesce(blank(e["text"]), blank(m["o"]["text"]), blank(m["v"]["text"]), F.lit("")).alias("text"),
                    F.least(
                        F.lit(1.0),
                        e["confidence"] * 0.55 + F.coalesce(m["o"]["confidence"], F.lit(0.0)) * 0.25
                        + F.coalesce(m["v"]["confidence"], F.lit(0.0)) * 0.2 + 0.1,
                    ).alias("confidence"),
                    F.lit("fused").alias("source"),
                    e["box"].alias("box"),
                )
            ),
        )

    refs = F.transform(dom, lambda e: e["ref"])
    return F.concat(F.transform(dom, fused), F.filter(F.concat(ocr, vision), lambda e: ~F.array_contains(refs, e["ref"])))


def opaque_mask(box: Column, width: Column, height: Column, margin_x: int = 8, margin_y: int = 8, align: bool = False) -> Column:
    """The painted rectangle and its core; null where nothing is left.  ``align`` widens it to 16-pixel blocks."""
    low = lambda v: F.greatest(F.lit(0.0), F.floor(v).cast("double"))
    high = lambda v, m: F.least(m.cast("double"), F.ceil(v).cast("double"))
    left, top = low(box["x1"] - margin_x), low(box["y1"] - margin_y)
    right, bottom = high(box["x2"] + margin_x, width), high(box["y2"] + margin_y, height)
    if align:
        left, top = F.floor(left / 16) * 16.0, F.floor(top / 16) * 16.0
        right, bottom = high(F.ceil(right / 16) * 16.0, width), high(F.ceil(bottom / 16) * 16.0, height)
    core = (low(box["x1"]), low(box["y1"]), high(box["x2"], width), high(box["y2"], height))
    ok = (right > left) & (bottom > top) & (core[2] > core[0]) & (core[3] > core[1])
    return F.when(
        ok,
        F.struct(
            left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"),
            core[0].alias("core_x"), core[1].alias("core_y"), (core[2] - core[0]).alias("core_width"), (core[3] - core[1]).alias("core_height"),
        ),
    )


def opaque_pixels(pixels: DataFrame, page: str, masks: DataFrame, level: int = 12) -> DataFrame:
    """(page, opaque): whether every pixel (x, y, r, g, b) inside the page's masks is dark.  For small images."""
    inside = (
        (F.col("p.x") >= F.col("m.core_x")) & (F.col("p.x") < F.col("m.core_x") + F.col("m.core_width"))
        & (F.col("p.y") >= F.col("m.core_y")) & (F.col("p.y") < F.col("m.core_y") + F.col("m.core_height"))
    )
    joined = pixels.alias("p").join(masks.alias("m"), (F.col(f"p.{page}") == F.col(f"m.{page}")) & inside)
    dark = (F.col("p.r") <= level) & (F.col("p.g") <= level) & (F.col("p.b") <= level)
    return joined.groupBy(F.col(f"p.{page}").alias(page)).agg(F.bool_and(dark).alias("opaque"))


def in_top_frame(box: Column, parents: Column) -> Column:
    """A box of a nested frame in the top frame's coordinates; parents from the inside out (x, y, scale_x, scale_y), at most 4."""
    step = lambda b, p: F.struct(
        (p["x"] + b["x"] * p["scale_x"]).alias("x"), (p["y"] + b["y"] * p["scale_y"]).alias("y"),
        (b["width"] * p["scale_x"]).alias("width"), (b["height"] * p["scale_y"]).alias("height"),
    )
    return F.aggregate(F.slice(parents, 1, 4), box, step)


def preview_mask(box: Column, sx: Column, sy: Column, width: Column, height: Column, margin: int = 2) -> Column:
    """The rectangle that a preview paints: scaled, rounded outwards, two pixels wider, clipped."""
    left = F.greatest(F.lit(0.0), F.floor(box["x"] * sx).cast("double") - margin)
    top = F.greatest(F.lit(0.0), F.floor(box["y"] * sy).cast("double") - margin)
    right = F.least(width.cast("double"), F.ceil((box["x"] + box["width"]) * sx).cast("double") + margin)
    bottom = F.least(height.cast("double"), F.ceil((box["y"] + box["height"]) * sy).cast("double") + margin)
    return corners(left, top, right, bottom)


def _in_mask(box: Column, masks: Column, width: Column, height: Column, margin: float = 4.0) -> Column:
    """Whether the box lies inside the verified part of one mask: four pixels around it."""
    return F.exists(
        masks,
        lambda m: (box["x1"] >= F.greatest(F.lit(0.0), m["x1"] - margin)) & (box["y1"] >= F.greatest(F.lit(0.0), m["y1"] - margin))
        & (box["x2"] <= F.least(width, m["x2"] + margin)) & (box["y2"] <= F.least(height, m["y2"] + margin)),
    )


def words_outside_masks(words: DataFrame, page: str, order: str, sure: float = 80.0) -> DataFrame:
    """The words that still need a look: rows of (page, order, confidence, box, masks, width, height).

    Words whose heights overlap, directly or through others, are a group.  A group is left out if the masks cover all of
    it and one of its words is uncertain.  Intervals on a line: a group ends where the next word begins below all before.
    """
    flagged = words.withColumn("_in", _in_mask(F.col("box"), F.col("masks"), F.col("width"), F.col("height")))
    ordered = Window.partitionBy(page).orderBy(F.col("box.y1"), order)
    lowest = F.max(F.col("box.y2")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    flagged = flagged.withColumn("_new", F.when(lowest.isNull() | (F.col("box.y1") >= lowest), 1).otherwise(0))
    flagged = flagged.withColumn("_group", F.sum("_new").over(ordered))
    group = Window.partitionBy(page, "_group")
    gone = F.min(F.col("_in").cast("int")).over(group) + F.max((F.col("confidence") < sure).cast("int")).over(group)
    return flagged.withColumn("_gone", gone).filter("_gone < 2").drop("_in", "_new", "_group", "_gone")


# Names of the reasons why uncertain words remain.
SCOPES = {
    "100": "COVERED_WORD_IN_MIXED_ROW", "010": "PARTIAL_MASK_OVERLAP", "001": "OUTSIDE_MASKS", "110": "COVERED_AND_PARTIAL",
    "101": "COVERED_AND_OUTSIDE", "011": "PARTIAL_AND_OUTSIDE", "111": "ALL_THREE", "000": "NONE",
}


def uncertain_scope(words: Column, masks: Column, width: Column, height: Column, sure: float = 80.0) -> Column:
    """One name for where the uncertain words of a page lie: inside masks, touching them, outside, or a mixture."""
    unsure = F.filter(words, lambda w: ~F.coalesce(w["confidence"].between(sure, 100), F.lit(False)))
    valid = lambda b: (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= width) & (b["y2"] <= height) & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])
    inside = lambda w: _in_mask(w["box"], masks, width, height)
    touches = lambda w: F.exists(masks, lambda m: intersection(w["box"], m) > 0)
    bit = lambda c: F.when(c, "1").otherwise("0")
    code = F.concat(
        bit(F.exists(unsure, inside)), bit(F.exists(unsure, lambda w: ~inside(w) & touches(w))), bit(F.exists(unsure, lambda w: ~inside(w) & ~touches(w)))
    )
    name = F.element_at(F.create_map(*[F.lit(x) for pair in SCOPES.items() for x in pair]), code)
    return F.when(words.isNull() | masks.isNull(), "UNAVAILABLE").when(
        F.exists(unsure, lambda w: ~F.coalesce(valid(w["box"]), F.lit(False))), "INVALID_GEOMETRY"
    ).otherwise(name)


def decode_faces(scores: Column, boxes: Column, width: Column, height: Column, threshold: float = 0.7) -> Column:
    """Kept faces (corners, score) of a tensor given as arrays of (background, score) and of four coordinates.

    Null if a value, a box or the number of faces is out of contract.
    """
    pairs = F.arrays_zip(scores.alias("s"), boxes.alias("b"))
    value_ok = lambda p: p["s"][0].between(0, 1) & p["s"][1].between(0, 1) & F.forall(p["b"], finite)
    sure = F.filter(pairs, lambda p: p["s"][1] >= threshold)
    geometry_ok = lambda p: (
        (p["b"][2] > p["b"][0]) & (p["b"][3] > p["b"][1]) & (p["b"][0] >= -1) & (p["b"][1] >= -1) & (p["b"][2] <= 2) & (p["b"][3] <= 2)
    )
    face = lambda p: F.struct(
        clip(p["b"][0] * width, 0.0, width).alias("x1"), clip(p["b"][1] * height, 0.0, height).alias("y1"),
        clip(p["b"][2] * width, 0.0, width).alias("x2"), clip(p["b"][3] * height, 0.0, height).alias("y2"), p["s"][1].alias("score"),
    )
    faces = F.transform(sure, face)
    ok = F.forall(pairs, value_ok) & F.forall(sure, geometry_ok) & F.forall(faces, lambda f: (f["x2"] > f["x1"]) & (f["y2"] > f["y1"]))
    return let(suppress(faces, 0.3, 31), lambda kept: F.when(ok & (F.size(kept) <= 30), kept))


def decode_controls(cells: Column, width: Column, height: Column, scale: Column, offset_x: Column, offset_y: Column) -> Column:
    """Kept controls (corners, score) of an array of six-value cells: centre, size, objectness, class score.

    Null if a confident cell is out of contract or more than 64 are kept.
    """
    sure = F.filter(cells, lambda c: c[4] * c[5] >= 0.75)
    one = lambda c: F.struct(
        ((c[0] - c[2] / 2 - offset_x) / scale).alias("x1"), ((c[1] - c[3] / 2 - offset_y) / scale).alias("y1"),
        ((c[0] + c[2] / 2 - offset_x) / scale).alias("x2"), ((c[1] + c[3] / 2 - offset_y) / scale).alias("y2"), (c[4] * c[5]).alias("score"),
    )
    boxes = F.transform(sure, one)
    ok = F.forall(cells, lambda c: F.forall(c, finite)) & F.forall(
        sure, lambda c: c[4].between(0, 1) & c[5].between(0, 1) & (c[2] > 0) & (c[3] > 0)
    )
    ok &= F.forall(boxes, lambda b: (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= width) & (b["y2"] <= height) & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    return let(suppress(boxes, 0.45, 65), lambda kept: F.when(ok & (F.size(kept) <= 64), kept))


def unreadable_regions(nodes: DataFrame, page: str, order: str, limit: int = 120) -> DataFrame:
    """Boxes of raster elements and of elements with a background image: distinct, 3 pixels or more, the first ones of a page."""
    raster = F.col("tag").isin("img", "canvas", "video", "svg", "object", "embed", "iframe", "picture")
    kind = F.when(raster, "RASTER_CONTENT").when(F.col("background") != "", "BACKGROUND_IMAGE")
    found = nodes.withColumn("kind", kind).filter(F.col("kind").isNotNull() & (F.col("width") >= 3) & (F.col("height") >= 3))
    rank = F.row_number().over(Window.partitionBy(page).orderBy(order))
    return found.withColumn("_n", rank).filter(F.col("_n") <= limit).drop("_n")


def rounded(box: Column) -> Column:
    return F.struct(*[half_up(box[c]).alias(c) for c in ("x", "y", "width", "height")])
