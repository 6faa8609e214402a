"""Evaluation: matching, percentiles, rates, edit distances and reports.

Three rules for empty denominators are kept apart: null (rates), zero (percent) and
at least one (labelled pixels).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up, let, one_spaced
from ..sources.tables import dealt
from .geometry import box_iou, finite, overlap_of_smaller


def _greedy(candidates: Column) -> Column:
    """Candidates (k, ti, oi) in order, each side used once: the array of those taken."""
    step = lambda taken, c: F.when(
        F.exists(taken, lambda t: (t["ti"] == c["ti"]) | (t["oi"] == c["oi"])), taken
    ).otherwise(F.concat(taken, F.array(c)))
    return F.aggregate(F.sort_array(candidates), F.expr("cast(array() as array<struct<k:double,ti:int,oi:int>>)"), step)


def _measured(side: DataFrame, page: str) -> DataFrame:
    """(page, index, tag, corners, area) of the boxes that are finite and positive."""
    b = {c: F.col(f"box.{c}") for c in ("x", "y", "width", "height")}
    ok = (b["width"] > 0) & (b["height"] > 0)
    for value in b.values():
        ok &= finite(value)
    corner = side.filter(ok).select(page, "index", "tag", b["x"].alias("x1"), b["y"].alias("y1"), (b["x"] + b["width"]).alias("x2"), (b["y"] + b["height"]).alias("y2"))
    return corner.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))


def match_boxes(truth: DataFrame, observed: DataFrame, page: str, threshold: float = 0.5, tagged: bool = True) -> DataFrame:
    """(page, tp, fp, fn, mean_iou) of a greedy one-to-one matching: best overlap first, then truth, then observed index.

    Sides are (page, index, tag, box); pairs come from a join by page (and tag) under the overlap condition.  With a threshold
    above 0 each side's corners and area are made before the join, and boxes that can't overlap enough are left out of it.
    """
    if threshold > 0:
        t, o = _measured(truth, page).alias("t"), _measured(observed, page).alias("o")
        shared = (F.least("t.x2", "o.x2") - F.greatest("t.x1", "o.x1")) * (F.least("t.y2", "o.y2") - F.greatest("t.y1", "o.y1"))
        overlap = shared / (F.col("t.area") + F.col("o.area") - shared)
        met = (F.col("t.x1") < F.col("o.x2")) & (F.col("o.x1") < F.col("t.x2")) & (F.col("t.y1") < F.col("o.y2")) & (F.col("o.y1") < F.col("t.y2"))
    else:
        t, o = truth.alias("t"), observed.alias("o")
        overlap, met = box_iou(F.col("t.box"), F.col("o.box")), F.lit(True)
    same = F.col(f"t.{page}") == F.col(f"o.{page}")
    if tagged:
        same &= F.col("t.tag") == F.col("o.tag")
    pairs = t.join(o, same & met & (overlap >= threshold)).select(
        F.col(f"t.{page}").alias(page), F.struct((-overlap).alias("k"), F.col("t.index").cast("int").alias("ti"), F.col("o.index").cast("int").alias("oi")).alias("c")
    )
    taken = pairs.groupBy(page).agg(F.collect_list("c").alias("c")).select(page, _greedy(F.col("c")).alias("m"))
    sides = truth.groupBy(page).agg(F.count(F.lit(1)).alias("nt")).join(observed.groupBy(page).agg(F.count(F.lit(1)).alias("no")), page, "full")
    joined = sides.join(taken, page, "left")
    tp = F.coalesce(F.size("m"), F.lit(0)).cast("long")
    mean = F.when(tp > 0, half_up(F.aggregate("m", F.lit(0.0), lambda a, x: a - x["k"]) / tp, 4))
    return joined.select(
        page, tp.alias("tp"), (F.coalesce("no", F.lit(0)) - tp).alias("fp"), (F.coalesce("nt", F.lit(0)) - tp).alias("fn"), mean.alias("mean_iou")
    )


def match_best(truth: Column, predicted: Column, least: float = 0.5) -> Column:
    """How many truths (kind, box) find a prediction of their kind: in order, each takes the free one that overlaps most."""

    numbered = F.transform(predicted, lambda p, i: F.struct(p["kind"].alias("kind"), p["box"].alias("box"), (-i).alias("i")))

    def step(known: Column, acc: Column, t: Column) -> Column:
        free = F.filter(known, lambda p: (p["kind"] == t["kind"]) & ~F.array_contains(acc["used"], -p["i"]))
        scored = F.filter(F.transform(free, lambda p: F.struct(overlap_of_smaller(t["box"], p["box"]).alias("v"), p["i"].alias("i"))), lambda s: s["v"] > 0)
        best = F.array_max(scored)
        return F.when(
            best["v"] >= least, F.struct((acc["n"] + 1).alias("n"), F.concat(acc["used"], F.array(-best["i"])).alias("used"))
        ).otherwise(acc)

    first = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("used"))
    return let(numbered, lambda known: F.aggregate(truth, first, lambda acc, t: step(known, acc, t), lambda a: a["n"]))


def match_multisets(expected: DataFrame, observed: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, tp, fp, fn): values with their multiplicity, by counts, so no value's rows are gathered."""
    both = expected.select(*group, value, F.lit(1).alias("e"), F.lit(0).alias("o")).unionByName(
        observed.select(*group, value, F.lit(0).alias("e"), F.lit(1).alias("o"))
    )
    counts = both.groupBy(*group, value).agg(F.sum("e").alias("e"), F.sum("o").alias("o"))
    shared = F.least("e", "o")
    return counts.groupBy(*group).agg(
        F.sum(shared).alias("tp"), F.sum(F.col("o") - shared).alias("fp"), F.sum(F.col("e") - shared).alias("fn")
    )


def timing_summary(samples: DataFrame, group: list[str], value: str, digits: int = 2) -> DataFrame:
    """(group, count, mean, p50, p95); empty groups have nulls.  Values are finite and not negative.

    A quantile is the value at rank ceil(n * q) of a group.  Equal values are counted first, and ranks are found by
    buckets of values within 0.3 per cent of each other, so a task reads a group's buckets and the values of two of them.
    """
    v = F.col(value).cast("double")
    bucket = F.when(F.isnan(v), 1 << 20).when(v > 0, F.floor(F.log2(v) * 256)).otherwise(-(1 << 20)).cast("int")
    counted = samples.groupBy(*group, value).agg(F.count(value).alias("_n"), F.sum(value).alias("_s")).withColumn("_b", bucket)
    buckets = counted.groupBy(*group, "_b").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    summary = buckets.groupBy(*group).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), half_up(F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0)), digits).alias("mean"))
    own = Window.partitionBy(*group)
    upto = own.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    placed = buckets.withColumns({"_all": F.sum("_n").over(own), "_upto": F.sum("_n").over(upto)})
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("q"), F.ceil(F.lit(q) * F.col("_all")).alias("rank")) for name, q in (("p50", 0.5), ("p95", 0.95))]))
    hit = placed.select(*group, "_b", "_n", "_upto", wanted.alias("_w")).filter("_w.rank > _upto - _n and _w.rank <= _upto")
    hit = hit.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_hb"), (F.col("_upto") - F.col("_n")).alias("_before"), "_w")

    def same(numbered: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, numbered, strict=True)], F.lit(True))

    keys = [f"_g{i}" for i in range(len(group))]
    near = counted.filter(F.col(value).isNotNull()).join(hit, same(keys) & (F.col("_b") == F.col("_hb")))
    running = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_w.q").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = near.select(*keys, "_w", F.col(value).alias("_v"), running.alias("_at")).filter("_at >= _w.rank")
    ranks = found.groupBy(*keys).agg(*[half_up(F.min(F.when(F.col("_w.q") == q, F.col("_v"))), digits).alias(q) for q in ("p50", "p95")])
    return summary.join(ranks, same(keys), "left").select(*group, "n", "mean", "p50", "p95")


def precision_recall(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column]:
    """Null where nothing was found or expected."""
    return tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))


def percent(part: Column, total: Column) -> Column:
    """Per cent with two digits, 0 of nothing."""
    return F.when(total != 0, half_up(part * 100 / total, 2)).otherwise(F.lit(0.0))


def f1_percent(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, half_up(2 * precision * recall / (precision + recall), 2)).otherwise(F.lit(0.0))


def mask_overlap(expected: DataFrame, predicted: DataFrame, page: str, width: int, height: int) -> DataFrame:
    """(page, expected, redacted, both): pixels that either side's boxes cover on the page's grid.

    A page is cut into bands between the tops and bottoms of its boxes; in a band the pixels are the length of the columns
    that boxes cover, so no pixel is a row.  A page has at most as many bands as the grid has lines, a band as many ranges
    as the grid has columns.  The grid is the picture: what a box has beyond it are no pixels.
    """

    def drawn(boxes: DataFrame, side: str) -> DataFrame:
        low = lambda c: F.greatest(F.lit(0), F.floor(c)).cast("int")
        high = lambda c, m: F.least(F.lit(m), F.ceil(c)).cast("int")
        return boxes.select(
            page, F.lit(side).alias("side"), low(F.col("box.x")).alias("x1"), low(F.col("box.y")).alias("y1"),
            high(F.col("box.x") + F.col("box.width"), width).alias("x2"), high(F.col("box.y") + F.col("box.height"), height).alias("y2"),
        ).filter("x2 > x1 and y2 > y1")

    def covered(ranges: Column) -> Column:
        """Columns in sorted ranges (x1, x2), each once."""
        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, r: F.struct(
            (a["n"] + F.greatest(F.lit(0), r["x2"] - F.greatest(r["x1"], a["end"]))).alias("n"), F.greatest(a["end"], r["x2"]).alias("end")
        )
        return F.aggregate(ranges, first, step, lambda a: a["n"])

    both = dealt(drawn(expected, "e").unionByName(drawn(predicted, "p")), page)
    ends = F.flatten(F.collect_set(F.array("y1", "y2")).over(Window.partitionBy(page)))
    boxes = both.withColumn("ends", F.array_sort(F.array_distinct(ends)))
    at = lambda y: F.array_position("ends", F.col(y)).cast("int")
    bands = boxes.select(page, "side", "x1", "x2", "ends", F.explode(F.sequence(at("y1"), at("y2") - 1)).alias("band"))
    bands = bands.withColumn("lines", F.col("ends")[F.col("band")] - F.col("ends")[F.col("band") - 1])
    # Of ranges that begin at one column the longest covers the others.
    bands = bands.groupBy(page, "band", "lines", "side", "x1").agg(F.max("x2").alias("x2"))
    of = lambda side: F.collect_set(F.when(F.col("side") == side, F.struct("x1", "x2")))
    bands = bands.groupBy(page, "band", "lines").agg(of("e").alias("e"), of("p").alias("p"))
    e, p, one = (covered(F.array_sort(c)) for c in (F.col("e"), F.col("p"), F.concat("e", "p")))
    counted = bands.select(page, (e * F.col("lines")).alias("e"), (p * F.col("lines")).alias("p"), (one * F.col("lines")).alias("one"))
    sums = counted.groupBy(page).agg(F.sum("e").alias("expected"), F.sum("p").alias("redacted"), F.sum("one").alias("one"))
    return sums.select(page, "expected", "redacted", (F.col("expected") + F.col("redacted") - F.col("one")).alias("both"))


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of words: words become characters, then strings are compared."""
    words = F.array_distinct(F.concat(a, b))
    # Words are numbered from code point U+4E00 on: 20,000 characters that are one UTF-16 unit each.
    code = lambda w: F.array_position(words, w)
    text = lambda xs: F.array_join(F.transform(xs, lambda w: F.decode(F.unhex(F.lpad(F.hex(code(w) + 0x4E00), 4, "0")), "UTF-16BE")), "")
    return F.levenshtein(text(a), text(b))


def recognition(reference: Column, observed: Column) -> Column:
    """(character_errors, characters, word_errors, words) after spaces are normalised; null for an empty reference.

    Distinct words of both texts must number fewer than 20,000, which single pages do.
    """
    e, o = one_spaced(reference), one_spaced(F.coalesce(observed, F.lit("")))
    none = F.expr("cast(array() as array<string>)")
    e_words, o_words = F.split(e, " "), F.when(o == "", none).otherwise(F.split(o, " "))
    return F.when(
        e != "",
        F.struct(
            F.levenshtein(e, o).alias("character_errors"), F.length(e).alias("characters"),
            word_distance(e_words, o_words).alias("word_errors"), F.size(e_words).alias("words"),
        ),
    )


def error_rates(pairs: DataFrame, group: list[str], result: str) -> DataFrame:
    """Micro-averaged character and word error rates per group, and whether every case is within both limits."""
    r = lambda f: F.sum(F.col(f"{result}.{f}"))
    return pairs.groupBy(*group).agg(
        (r("character_errors") / r("characters")).alias("cer"), (r("word_errors") / r("words")).alias("wer"),
        F.count(F.lit(1)).alias("cases"),
    )


def cpu_delta(before: DataFrame, after: DataFrame, key: str, value: str, elapsed_ms: float) -> DataFrame:
    """(matched_seconds, percent_of_core) of processes seen both before and after; a clock that went back counts as 0."""
    joined = before.select(key, F.col(value).alias("_b")).join(after.select(key, F.col(value).alias("_a")), key)
    used = F.sum(F.greatest(F.lit(0.0), F.col("_a") - F.col("_b")))
    return joined.agg(half_up(used, 4).alias("matched_seconds"), half_up(used * 100000 / elapsed_ms, 2).alias("percent_of_core"))


def source_fingerprint(files: DataFrame, name: str, content: str) -> DataFrame:
    """One SHA-256 over names and contents in name order; first each file's own digest, so only digests are gathered."""
    one = files.select(F.concat(F.col(name), F.lit("\u0000"), F.sha2(F.col(content), 256)).alias("line"))
    joined = one.agg(F.array_join(F.sort_array(F.collect_list("line")), "\u0000").alias("all"))
    return joined.select(F.sha2("all", 256).alias("fingerprint"))


def changed_pixels(pixels: DataFrame, region: str, level: int = 48) -> DataFrame:
    """(region, pixels, changed, percent): pixels whose colours differ by more than the level in sum."""
    moved = F.abs(F.col("r1") - F.col("r2")) + F.abs(F.col("g1") - F.col("g2")) + F.abs(F.col("b1") - F.col("b2")) > level
    counted = pixels.groupBy(region).agg(F.count(F.lit(1)).alias("pixels"), F.count_if(moved).alias("changed"))
    return counted.withColumn("percent", percent(F.col("changed"), F.col("pixels")))


def labelled_confusion(opaque: Column, labelled: Column) -> list[Column]:
    """Aggregates: recall, precision and share outside, in per cent with denominators of one at least."""
    n = lambda c: F.count_if(c)
    share = lambda a, b: half_up(10000 * a / F.greatest(F.lit(1), b)) / 100
    return [
        share(n(labelled & opaque), n(labelled)).alias("recall"), share(n(labelled & opaque), n(opaque)).alias("precision"),
        share(n(~labelled & opaque), n(~labelled)).alias("outside"),
    ]

