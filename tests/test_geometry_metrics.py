"""Geometry and metrics against literal expectations and plain mirrors."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from cloakwork.operators import geometry as g
from cloakwork.operators import metrics as m

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_union_of_boxes_is_transitive(spark):
    rng = random.Random(2)

    def union(boxes):
        merged = []
        for b in boxes:
            now, i = list(b), 0
            while i < len(merged):
                p = merged[i]
                if now[0] < p[2] and now[2] > p[0] and now[1] < p[3] and now[3] > p[1]:
                    now = [min(now[0], p[0]), min(now[1], p[1]), max(now[2], p[2]), max(now[3], p[3])]
                    merged.pop(i)
                    i = 0
                else:
                    i += 1
            merged.append(now)
        return sorted(map(tuple, merged))

    pages = [[(float(x), float(y), x + float(rng.randint(1, 6)), y + float(rng.randint(1, 6))) for x, y in [(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(rng.randint(0, 9))]] for _ in range(80)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], f"i int, b array<{BOX}>")
    got = rows.select("i", g.union_boxes(F.col("b")).alias("u")).orderBy("i").collect()
    assert [sorted(tuple(b) for b in r.u) for r in got] == [union(p) for p in pages]


def test_matching_examples(spark):
    side = "page int, index int, tag string, box struct<x:double,y:double,width:double,height:double>"
    box = lambda x: (float(x), 0.0, 10.0, 10.0)
    truth = spark.createDataFrame([(1, 0, "a", box(0)), (1, 1, "a", box(50)), (2, 0, "a", box(0))], side)
    seen = spark.createDataFrame([(1, 0, "a", box(0)), (1, 1, "a", box(80)), (2, 0, "a", box(0)), (2, 1, "a", box(0)), (3, 0, "a", box(0))], side)
    got = {r.page: (r.tp, r.fp, r.fn) for r in m.match_boxes(truth, seen, "page").collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 0), 3: (0, 1, 0)}


def test_kind_multisets(spark):
    e = spark.createDataFrame([("EMAIL",), ("EMAIL",), ("PHONE",)], "k string")
    o = spark.createDataFrame([("PHONE",), ("EMAIL",), ("API_KEY",)], "k string")
    assert tuple(m.match_multisets(e, o, [], "k").first()) == (2, 1, 1)


def test_timings(spark):
    rows = spark.createDataFrame([(float(v),) for v in (3, 1, 2, 5, 4)], "v double")
    assert tuple(m.timing_summary(rows, [], "v").first()) == (5, 3.0, 3.0, 5.0)
    assert tuple(m.timing_summary(rows.limit(0), [], "v").first()) == (0, None, None, None)


def test_recognition(spark):
    r = lambda a, b: one(spark, m.recognition(F.lit(a), F.lit(b)))
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    assert tuple(r("a b", "")) == (3, 3, 2, 2)
    assert r("a", "a b c").word_errors == 2
    assert r("  ", "x") is None


def test_zero_rules(spark):
    zero, three = F.lit(0), F.lit(3)
    assert one(spark, m.precision_recall(zero, zero, three)[0]) is None
    assert one(spark, m.percent(zero, zero)) == 0.0
    rows = spark.createDataFrame([(False, False)], "o boolean, l boolean")
    assert tuple(rows.agg(*m.labelled_confusion(F.col("o"), F.col("l"))).first()) == (0.0, 0.0, 0.0)


def test_invalid_words_mask_everything(spark):
    kind = f"w array<struct<text:string,confidence:double,box:{BOX}>>"
    word = lambda t, c, x: (t, float(c), (float(x), 0.0, x + 10.0, 10.0))
    rows = spark.createDataFrame([([word("a@b", 90, 0), word(".co", 90, 12), word("far", 90, 80)],), ([word("x", 10, 0), word("y", 90, 11)],), ([word("", 90, 0)],), ([],)], kind)
    got = [(r.v.full, [tuple(b) for b in r.v.regions]) for r in rows.select(g.review_words(F.col("w"), F.lit(100.0), F.lit(20.0)).alias("v")).collect()]
    assert got == [(False, [(0.0, 0.0, 22.0, 10.0)]), (False, [(0.0, 0.0, 21.0, 10.0)]), (True, []), (True, [])]


def test_suppression_keeps_the_best_first(spark):
    boxes = [(0.5, 0.0, 0.0, 10.0, 10.0), (0.9, 1.0, 0.0, 11.0, 10.0), (0.7, 50.0, 0.0, 60.0, 10.0)]
    rows = spark.createDataFrame([(boxes,)], "b array<struct<score:double,x1:double,y1:double,x2:double,y2:double>>")
    assert [k.score for k in rows.select(g.suppress(F.col("b")).alias("k")).first().k] == [0.9, 0.7]


def test_face_tensor(spark):
    scores = F.array(F.array(F.lit(0.1), F.lit(0.9)), F.array(F.lit(0.9), F.lit(0.1)))
    boxes = F.array(F.array(*map(F.lit, (0.1, 0.2, 0.5, 0.6))), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))))
    got = one(spark, g.decode_faces(scores, boxes, F.lit(100.0), F.lit(50.0)))
    assert [tuple(f) for f in got] == [(10.0, 10.0, 50.0, 30.0, 0.9)]
    bad = F.array(F.array(*map(F.lit, (0.5, 0.2, 0.1, 0.6))), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))))
    assert one(spark, g.decode_faces(scores, bad, F.lit(100.0), F.lit(50.0))) is None


def test_best_overlap_matching_against_a_mirror(spark):
    rng = random.Random(9)

    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        return max(0, w) * max(0, h) / max(1, min(size(a), size(b)))

    def mirror(truth, seen):
        free, n = set(range(len(seen))), 0
        for kind, box in truth:
            best, value = -1, 0.0
            for i in sorted(free):
                if seen[i][0] == kind and overlap(box, seen[i][1]) > value:
                    best, value = i, overlap(box, seen[i][1])
            if best >= 0 and value >= 0.5:
                free.discard(best)
                n += 1
        return n

    def side():
        made = []
        for _ in range(rng.randint(0, 6)):
            x, y = float(rng.randint(0, 12)), float(rng.randint(0, 12))
            made.append((rng.choice("ab"), (x, y, x + rng.randint(2, 8), y + rng.randint(2, 8))))
        return made

    pages = [(side(), side()) for _ in range(120)]
    kind = f"array<struct<kind:string,box:{BOX}>>"
    rows = spark.createDataFrame([(i, t, o) for i, (t, o) in enumerate(pages)], f"i int, t {kind}, o {kind}")
    got = rows.select("i", m.match_best(F.col("t"), F.col("o")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [mirror(t, o) for t, o in pages]


def _rows_mirror(words):
    """Rows of words (text, confidence, box) by the stated rule, with plain lists."""
    rows = []
    for n in sorted(range(len(words)), key=lambda n: (words[n][2][1] + words[n][2][3], words[n][2][0], n)):
        x1, y1, _, y2 = words[n][2]
        for row in rows:
            low, high = row["top"], row["bottom"]
            shared, near = min(y2, high) - max(y1, low), abs((y1 + y2) / 2 - (low + high) / 2)
            if shared >= 0.45 * min(y2 - y1, high - low) and near <= 0.6 * max(y2 - y1, high - low):
                row.update(top=min(low, y1), bottom=max(high, y2), words=[*row["words"], (x1, y1, n)])
                break
        else:
            rows.append({"top": y1, "bottom": y2, "words": [(x1, y1, n)]})
    return [(r["top"], r["bottom"], [words[n][0] for _, _, n in sorted(r["words"])]) for r in rows]


def _runs_mirror(words):
    runs = []
    for w in words:
        if runs:
            edge = max(runs[-1], key=lambda r: r[2][2])  # the first of those that reach as far
            tall = max(b[3] - b[1] for b in (edge[2], w[2]))
            if w[2][0] - edge[2][2] <= max(12, min(32, math.ceil(0.75 * tall))):
                runs[-1].append(w)
                continue
        runs.append([w])
    return [[w[0] for w in run] for run in runs]


def test_uneven_rows_and_runs_as_mirrored(spark):
    rng = random.Random(5)
    pages = [[]]
    for _ in range(60):
        boxes = [(float(rng.randrange(150)), float(rng.randrange(60)), rng.randrange(4, 50), rng.randrange(3, 40)) for _ in range(rng.randrange(1, 12))]
        pages.append([(f"w{i}", 90.0, (x, y, x + w, y + h)) for i, (x, y, w, h) in enumerate(boxes)])
    rows = spark.createDataFrame(list(enumerate(pages)), f"i int, w array<struct<text:string,confidence:double,box:{BOX}>>")
    for r in rows.select("i", g.group_rows(F.col("w")).alias("rows"), g.runs_of(F.col("w")).alias("runs")).collect():
        assert [(x.top, x.bottom, [w.text for w in x.words]) for x in r.rows] == _rows_mirror(pages[r.i])
        assert [[w.text for w in run] for run in r.runs] == _runs_mirror(pages[r.i])


def test_pixels_of_many_boxes_without_a_row_for_each_pixel(spark):
    """Boxes that overlap, leave the grid, repeat or have no area, held against painted grids; a grid far too large to paint."""
    dealer = random.Random(5)
    sides = [[(p, dealer.randint(-8, 40) / 2, dealer.randint(-8, 30) / 2, dealer.randint(0, 30) / 2, dealer.randint(0, 20) / 2) for p in (1, 2, 3) for _ in range(n)] for n in (7, 5)]
    frames = [spark.createDataFrame([(p, (x, y, w, h)) for p, x, y, w, h in side], "page long, box struct<x:double,y:double,width:double,height:double>") for side in sides]

    def painted(side: list[tuple], page: int) -> set:
        spots = set()
        for p, x, y, w, h in side:
            if p == page:
                spots |= {(i, j) for i in range(max(0, math.floor(x)), min(18, math.ceil(x + w))) for j in range(max(0, math.floor(y)), min(12, math.ceil(y + h)))}
        return spots

    got = {r["page"]: (r["expected"], r["redacted"], r["both"]) for r in m.mask_overlap(*frames, "page", 18, 12).collect()}
    both = {p: (painted(sides[0], p), painted(sides[1], p)) for p in (1, 2, 3)}
    assert got == {p: (len(a), len(b), len(a & b)) for p, (a, b) in both.items() if a or b}
    large = spark.createDataFrame([(1, (0.0, 0.0, 90000.0, 80000.0))], frames[0].schema)
    assert m.mask_overlap(large, large, "page", 100_000, 100_000).collect() == [(1, 7_200_000_000, 7_200_000_000, 7_200_000_000)]


def test_matching_condition_is_short_and_skips_boxes_that_are_not_finite(spark):
    """What is compared for each pair of a page stays a few comparisons of columns made before the join."""
    box = "page long, index int, tag string, box struct<x:double,y:double,width:double,height:double>"
    truth = spark.createDataFrame([(1, 1, "a", (0.0, 0.0, 10.0, 10.0)), (1, 2, "b", (0.0, 0.0, float("inf"), 10.0)), (1, 3, "a", (0.0, 0.0, 0.0, 10.0)), (2, 1, "a", (5.0, 5.0, 4.0, 4.0))], box)
    seen = spark.createDataFrame([(1, 1, "b", (0.0, 0.0, 10.0, 8.0)), (1, 2, "b", (float("nan"), 0.0, 10.0, 10.0)), (3, 1, "a", (5.0, 5.0, 4.0, 4.0))], box)
    done = m.match_boxes(truth, seen, "page", 0.5, False)
    assert sorted(done.collect()) == [(1, 1, 1, 2, 0.8), (2, 0, 0, 1, None), (3, 0, 1, 0, None)]
    join = next(x for x in done._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert len(join) < 1500 and "isnan" not in join.lower()
