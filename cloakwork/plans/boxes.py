"""Queries of families C and F.  Boxes are synthetic: they come from the integers of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators import metrics as m
from ..operators import unions
from ..sources.tables import dealt, table

_X, _Y = "CAST(l_partkey % 50 AS DOUBLE)", "CAST(l_suppkey % 40 AS DOUBLE)"
_W, _H = "CAST(5 + l_quantity AS DOUBLE)", "CAST(5 + 3 * l_linenumber AS DOUBLE)"
_REF = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"
_BOXES = f"""b AS (SELECT l_orderkey AS page, {_REF} AS ref, l_partkey AS part, l_returnflag AS tag, l_discount * 10 AS score,
  {_X} AS x, {_Y} AS y, {_W} AS width, {_H} AS height, {_X} AS x1, {_Y} AS y1, {_X} + {_W} AS x2, {_Y} + {_H} AS y2 FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str, by_page: bool = True) -> DataFrame:
    """A box for each line, dealt by page unless its pages aren't asked for."""
    e = F.expr
    lines = table(spark, sf_dir, "lineitem")
    rows = (dealt(lines, "l_orderkey") if by_page else lines).select(
        e("l_orderkey").alias("page"), e(_REF).alias("ref"), e("l_partkey").alias("part"), e("l_returnflag").alias("tag"), e("l_discount * 10").alias("score"),
        e(_X).alias("x"), e(_Y).alias("y"), e(_W).alias("width"), e(_H).alias("height"),
    )
    return rows.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("width"), "y2": F.col("y") + F.col("height")})


def _corner(alias: str = "") -> Column:
    p = f"{alias}." if alias else ""
    return g.corners(*[F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")])


def _xywh() -> Column:
    return F.struct("x", "y", "width", "height")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of one page, each once."""
    b = boxes(spark, sf_dir)
    return b.alias("a").join(b.alias("c"), (F.col("a.page") == F.col("c.page")) & (F.col("a.ref") < F.col("c.ref")))


def inter_sql(a: str, b: str) -> str:
    return (
        f"(greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    )


def area_sql(a: str) -> str:
    return f"(greatest(0.0, {a}.x2 - {a}.x1) * greatest(0.0, {a}.y2 - {a}.y1))"


def iou_sql(a: str, b: str) -> str:
    union = f"({area_sql(a)} + {area_sql(b)} - {inter_sql(a, b)})"
    return f"CASE WHEN {union} > 0 THEN {inter_sql(a, b)} / {union} ELSE 0.0 END"


def union_sql(arrays: str, name: str = "united") -> str:
    """CTE (page, bs) of the boxes of (page, bs) after those that overlap have become one; for WITH RECURSIVE.

    Every box grows to all that it touches, all at once, until nothing changes.
    """
    near = "list_filter(bs, lambda b: b = a OR (a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1))"
    sides = ", ".join(f"'{n}': {f}(list_transform({near}, lambda b: b.{n}))" for n, f in (("x1", "list_min"), ("y1", "list_min"), ("x2", "list_max"), ("y2", "list_max")))
    return f"""growing AS (SELECT page, 0 AS step, list_sort(list_distinct(bs)) AS bs FROM ({arrays})
  UNION ALL SELECT page, step + 1, wider FROM (SELECT *, list_sort(list_distinct(list_transform(bs, lambda a: {{{sides}}}))) AS wider FROM growing) WHERE wider <> bs),
{name} AS (SELECT page, arg_max(bs, step) AS bs FROM growing GROUP BY page)"""


_PAIR_SQL = f"WITH {_BOXES} SELECT a.page, a.ref AS ra, c.ref AS rc, {{0}} AS v FROM b a JOIN b c ON a.page = c.page AND a.ref < c.ref"


def c01_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a.page", F.col("a.ref").alias("ra"), F.col("c.ref").alias("rc"), g.iou(_corner("a"), _corner("c")).alias("v"))


def c03_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap of pairs whose boxes are corners, have sizes, or are given as an area that is shared and two that are whole."""
    a, c = _corner("a"), _corner("c")
    sized = lambda t: F.struct(*[F.col(f"{t}.{n}").alias(n) for n in ("x", "y", "width", "height")])
    forms = {"by_corners": g.iou(a, c), "by_sizes": g.box_iou(sized("a"), sized("c")), "by_areas": g.overlap_of_areas(g.intersection(a, c), g.area(a), g.area(c))}
    return _pairs(spark, sf_dir).select("a.page", F.col("a.ref").alias("ra"), F.col("c.ref").alias("rc"), *[v.alias(k) for k, v in forms.items()])


C03 = f"WITH {_BOXES} SELECT a.page, a.ref AS ra, c.ref AS rc, {iou_sql('a', 'c')} AS by_corners, {iou_sql('a', 'c')} AS by_sizes, {iou_sql('a', 'c')} AS by_areas FROM b a JOIN b c ON a.page = c.page AND a.ref < c.ref"


def c02_box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth box has no width, which counts as no overlap."""
    side = lambda t: F.struct(F.col(f"{t}.x").alias("x"), F.col(f"{t}.y").alias("y"), F.when(F.col(f"{t}.part") % 5 == 0, 0.0).otherwise(F.col(f"{t}.width")).alias("width"), F.col(f"{t}.height").alias("height"))
    return _pairs(spark, sf_dir).select("a.page", F.col("a.ref").alias("ra"), F.col("c.ref").alias("rc"), g.box_iou(side("a"), side("c")).alias("v"))


def c04_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a.page", F.col("a.ref").alias("ra"), F.col("c.ref").alias("rc"), g.overlap_of_smaller(_corner("a"), _corner("c")).alias("v"))


def _suppressed(threshold: float, limit: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = F.struct("ref", "score", "x1", "y1", "x2", "y2")
        pages = boxes(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(one)).alias("all"))
        kept = pages.select("page", g.suppress(F.col("all"), threshold, limit).alias("kept"))
        return kept.select("page", F.array_join(F.transform("kept", lambda k: k["ref"].cast("string")), ",").alias("kept"))

    return run


def _suppressed_sql(threshold: float, limit: int) -> str:
    return f"""WITH {_BOXES},
l AS (SELECT page, list([{{'ref': ref, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY score DESC, ref) AS xs FROM b GROUP BY page),
k AS (SELECT page, list_reduce(xs, lambda acc, x: CASE WHEN len(acc) >= {limit}
   OR len(list_filter(acc, lambda k: {iou_sql('k', 'x[1]')} > {threshold})) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM l)
SELECT page, array_to_string(list_transform(kept, lambda k: CAST(k.ref AS VARCHAR)), ',') AS kept FROM k"""


_VIEW = {"w": "1000E0 + part % 7", "h": "800E0", "vw": "500E0 + (part % 5) * 2E0", "vh": "400E0", "d": "CASE WHEN part % 9 = 0 THEN 3E0 ELSE 2E0 END"}


def c09_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = {k: F.expr(x) for k, x in _VIEW.items()}
    s = g.capture_scale(v["w"], v["h"], v["vw"], v["vh"], v["d"])
    return boxes(spark, sf_dir).select("page", "ref", s.alias("s")).select("page", "ref", "s.safe", "s.scale_x", "s.scale_y")


C09 = f"""WITH {_BOXES}, v AS (SELECT page, ref, ({_VIEW['w']}) / ({_VIEW['vw']}) AS sx, ({_VIEW['h']}) / ({_VIEW['vh']}) AS sy, {_VIEW['d']} AS d FROM b),
s AS (SELECT *, greatest(sx, sy) / least(sx, sy) <= 1.02::DOUBLE AND greatest(sx, d) / least(sx, d) <= 1.1::DOUBLE AS safe FROM v)
SELECT page, ref, safe, CASE WHEN safe THEN sx END AS scale_x, CASE WHEN safe THEN sy END AS scale_y FROM s"""


def c10_map_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = g.map_box(_xywh(), F.lit(2.0), F.lit(1.5), F.lit(120.0), F.lit(70.0))
    return boxes(spark, sf_dir).select("page", "ref", mapped.alias("m")).select("page", "ref", "m.*")


C10 = f"""WITH {_BOXES} SELECT page, ref, least(120.0, greatest(0.0, x * 2.0)) AS x1, least(70.0, greatest(0.0, y * 1.5)) AS y1,
  least(120.0, greatest(0.0, (x + width) * 2.0)) AS x2, least(70.0, greatest(0.0, (y + height) * 1.5)) AS y2 FROM b"""

_FIT = "CASE part % 6 WHEN 0 THEN 'fill' WHEN 1 THEN 'contain' WHEN 2 THEN 'cover' WHEN 3 THEN 'none' WHEN 4 THEN 'scale-down' ELSE 'stretch' END"


def c11_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on an image of 100 by 80 that is shown 60 by 60 in six ways."""
    surface = F.struct(
        F.struct(F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(60.0).alias("width"), F.lit(60.0).alias("height")).alias("rect"),
        F.lit(100.0).alias("intrinsic_width"), F.lit(80.0).alias("intrinsic_height"), F.expr(_FIT).alias("object_fit"),
        F.lit(0.5).alias("position_x"), F.lit(0.25).alias("position_y"),
    )
    mapped = g.map_surface(_corner(), surface, F.lit(2.0), F.lit(2.0), F.lit(150.0), F.lit(200.0))
    return boxes(spark, sf_dir).select("page", "ref", mapped.alias("m")).filter("m is not null").select("page", "ref", "m.*")


def _surface_sql() -> str:
    clip = lambda v, lo, hi: f"least({hi}, greatest({lo}, {v}))"
    x = lambda c: clip(f"{clip(f'lx + {c} * sw / 100.0', '10.0', '70.0')} * 2.0", "0.0", "150.0")
    y = lambda c: clip(f"{clip(f'ly + {c} * sh / 80.0', '20.0', '80.0')} * 2.0", "0.0", "200.0")
    return f"""WITH {_BOXES}, f AS (SELECT *, {_FIT} AS fit FROM b WHERE {_FIT} <> 'stretch'),
k AS (SELECT *, CASE fit WHEN 'contain' THEN least(60.0::DOUBLE / 100.0, 60.0::DOUBLE / 80.0) WHEN 'cover' THEN greatest(60.0::DOUBLE / 100.0, 60.0::DOUBLE / 80.0)
   WHEN 'scale-down' THEN least(1.0::DOUBLE, least(60.0::DOUBLE / 100.0, 60.0::DOUBLE / 80.0)) ELSE 1.0::DOUBLE END AS k FROM f),
s AS (SELECT *, CASE WHEN fit = 'fill' THEN 60.0::DOUBLE ELSE 100.0 * k END AS sw, CASE WHEN fit = 'fill' THEN 60.0::DOUBLE ELSE 80.0 * k END AS sh FROM k),
o AS (SELECT *, 10.0 + (60.0 - sw) * 0.5 AS lx, 20.0 + (60.0 - sh) * 0.25 AS ly FROM s),
r AS (SELECT page, ref, {x('x1')} AS x1, {y('y1')} AS y1, {x('x2')} AS x2, {y('y2')} AS y2 FROM o)
SELECT * FROM r WHERE x2 > x1 AND y2 > y1"""


def c13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = boxes(spark, sf_dir).withColumns({"x1": F.col("x1") * 4, "x2": F.col("x1") * 4 + F.col("width")})
    return g.split_runs(wide, ["page"], ["x1", "ref"]).select("page", "ref", F.col("run").cast("long").alias("run"))


C13 = f"""WITH {_BOXES}, w AS (SELECT page, ref, x1 * 4 AS x1, x1 * 4 + width AS x2, y2 - y1 AS h FROM b),
e AS (SELECT *, max(x2) OVER o AS edge, max(struct_pack(x := x2, h := h)) OVER o AS top FROM w
  WINDOW o AS (PARTITION BY page ORDER BY x1, ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, CASE WHEN edge IS NULL THEN 0 WHEN x1 - edge > greatest(12, least(32, ceil(greatest(top.h, h) * 0.75))) THEN 1 ELSE 0 END AS new FROM e)
SELECT page, ref, CAST(sum(new) OVER (PARTITION BY page ORDER BY x1, ref) AS BIGINT) AS run FROM n"""


def _page_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("ref", _corner().alias("box"))
    return boxes(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(one)).alias("all"))


def c16_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas after overlapping boxes of a page have become one."""
    merged = _page_arrays(spark, sf_dir).select("page", g.union_boxes(F.transform("all", lambda a: a["box"])).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda t, b: t + g.area(b))
    return merged.select("page", F.size("u").cast("long").alias("n"), total.alias("area"))


_LISTED = "list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2})"
C16 = f"""WITH RECURSIVE {_BOXES}, {union_sql(f'SELECT page, {_LISTED} AS bs FROM b GROUP BY page')}
SELECT page, len(bs) AS n, list_sum(list_transform(bs, lambda z: {area_sql('z')})) AS area FROM united"""


def c16_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a page's boxes in one array; pages of a hundred orders, so that there is something to unite."""
    rows = boxes(spark, sf_dir).withColumn("page", F.expr("page div 100")).withColumns({"x1": F.expr("x1 + page % 7 * 40"), "x2": F.expr("x2 + page % 7 * 40")})
    made = unions.unite_boxes(rows, "page")
    return made.groupBy("page").agg(F.count("*").alias("n"), F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))


C16_UNITED = f"""WITH RECURSIVE {_BOXES}, c AS (SELECT page // 100 AS page, x1 + page // 100 % 7 * 40 AS x1, y1, x2 + page // 100 % 7 * 40 AS x2, y2 FROM b),
{union_sql(f'SELECT page, {_LISTED} AS bs FROM c GROUP BY page')}
SELECT page, len(bs) AS n, list_sum(list_transform(bs, lambda z: {area_sql('z')})) AS area FROM united"""


def c18_bounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = g.bounding(F.transform("all", lambda a: a["box"]))
    return _page_arrays(spark, sf_dir).select("page", around.alias("m")).select("page", "m.*")


C18 = f"WITH {_BOXES} SELECT page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM b GROUP BY page"


def _masked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumns({"confidence": F.col("score") * 100.0, "box": _corner(), "width": F.lit(200.0), "height": F.lit(200.0)})
    return b.withColumn("masks", F.array(g.corners(F.lit(0.0), F.lit(0.0), F.lit(70.0), F.lit(45.0))))


def c19_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.words_outside_masks(_masked_words(spark, sf_dir), "page", "ref").select("page", "ref")


C19 = f"""WITH RECURSIVE {_BOXES},
w AS (SELECT page, ref, y1, y2, score * 100.0 < 80 AS unsure, x2 <= 74 AND y2 <= 49 AS inside FROM b),
e AS (SELECT a.page, a.ref, c.ref AS other FROM w a JOIN w c ON a.page = c.page AND a.y1 < c.y2 AND a.y2 > c.y1),
r AS (SELECT page, ref, ref AS low FROM w UNION SELECT r.page, e.other, r.low FROM r JOIN e ON e.page = r.page AND e.ref = r.ref),
g AS (SELECT page, ref, min(low) AS grp FROM r GROUP BY page, ref),
x AS (SELECT g.page, grp, bool_and(inside) AND bool_or(unsure) AS gone FROM g JOIN w ON w.page = g.page AND w.ref = g.ref GROUP BY g.page, grp)
SELECT g.page, g.ref FROM g JOIN x ON x.page = g.page AND x.grp = g.grp WHERE NOT x.gone"""


def c20_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _masked_words(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("ref", "confidence", "box"))).alias("words"), F.first("masks").alias("masks"))
    return pages.select("page", g.uncertain_scope(F.col("words"), F.col("masks"), F.lit(200.0), F.lit(200.0)).alias("scope"))


C20 = f"""WITH {_BOXES},
w AS (SELECT page, CASE WHEN x2 <= 74 AND y2 <= 49 THEN 'c' WHEN x1 < 70 AND y1 < 45 THEN 'p' ELSE 'o' END AS k, score * 100.0 < 80 AS unsure FROM b),
s AS (SELECT page, bool_or(unsure AND k = 'c') AS c, bool_or(unsure AND k = 'p') AS p, bool_or(unsure AND k = 'o') AS o FROM w GROUP BY page)
SELECT page, CASE WHEN c AND p AND o THEN 'ALL_THREE' WHEN c AND p THEN 'COVERED_AND_PARTIAL' WHEN c AND o THEN 'COVERED_AND_OUTSIDE' WHEN p AND o THEN 'PARTIAL_AND_OUTSIDE'
  WHEN c THEN 'COVERED_WORD_IN_MIXED_ROW' WHEN p THEN 'PARTIAL_MASK_OVERLAP' WHEN o THEN 'OUTSIDE_MASKS' ELSE 'NONE' END AS scope FROM s"""


def c21_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the odd lines' boxes of an order all lie inside one of the even lines' boxes."""
    b = boxes(spark, sf_dir).withColumn("box", _xywh())
    side = lambda p: F.filter(F.collect_list(F.when(p, F.col("box"))), lambda x: x.isNotNull())
    pages = b.groupBy("page").agg(side(F.col("ref") % 2 == 1).alias("odd"), side(F.col("ref") % 2 == 0).alias("even"))
    return pages.select("page", g.covered(F.col("odd"), F.col("even")).alias("covered"))


C21 = f"""WITH {_BOXES}, o AS (SELECT a.page, bool_or(coalesce(a.x >= c.x AND a.y >= c.y AND a.x + a.width <= c.x + c.width AND a.y + a.height <= c.y + c.height, false)) AS ok
  FROM b a LEFT JOIN b c ON c.page = a.page AND c.ref % 2 = 0 WHERE a.ref % 2 = 1 GROUP BY a.page, a.ref)
SELECT p.page, coalesce(bool_and(o.ok), true) AS covered FROM (SELECT DISTINCT page FROM b) p LEFT JOIN o ON o.page = p.page GROUP BY p.page"""


def c22_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    controls = b.select("page", "ref", _corner().alias("box"), (F.col("tag") == "R").alias("sensitive"))
    seen = b.select("page", F.col("ref").alias("detection"), g.corners(F.col("x1") + 1, F.col("y1"), F.col("x2") + F.col("part") % 3, F.col("y2")).alias("box"))
    fused = g.fuse_detections(seen, controls, "page")
    total = F.aggregate("regions", F.lit(0.0), lambda t, r: t + g.area(r))
    return fused.select("page", "ok", F.size("matched").cast("long").alias("matched"), total.alias("area"))


C22 = f"""WITH {_BOXES}, d AS (SELECT page, ref AS det, x1 + 1 AS x1, y1, x2 + part % 3 AS x2, y2 FROM b),
j AS (SELECT d.page, det, count(c.ref) AS n, min(c.ref) AS ref,
   min(CASE WHEN c.tag = 'R' THEN (greatest(c.x2, d.x2) - least(c.x1, d.x1)) * (greatest(c.y2, d.y2) - least(c.y1, d.y1)) END) AS area
   FROM d LEFT JOIN b c ON c.page = d.page AND {iou_sql('c', 'd')} >= 0.5 GROUP BY d.page, det),
p AS (SELECT page, bool_and(n = 1) AND count(DISTINCT ref) = count(ref) AS ok, count(ref) AS matched, coalesce(sum(area), 0.0) AS area FROM j GROUP BY page)
SELECT page, ok, CASE WHEN ok THEN matched ELSE 0 END AS matched, CASE WHEN ok THEN area ELSE 0.0 END AS area FROM p"""


def c23_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as three sources by line number; fused texts and confidences."""
    e = F.struct(F.concat(F.lit("c"), F.col("ref")).alias("ref"), F.when(F.col("ref") % 3 == 1, "").otherwise(F.col("tag")).alias("text"), F.col("score").alias("confidence"), F.lit("dom").alias("source"), _xywh().alias("box"))
    side = lambda n: F.filter(F.transform(F.sort_array(F.collect_list(F.when(F.col("ref") % 3 == n, F.struct("ref", e.alias("e"))))), lambda x: x["e"]), lambda x: x.isNotNull())
    pages = boxes(spark, sf_dir).groupBy("page").agg(side(1).alias("dom"), side(2).alias("ocr"), side(0).alias("vision"))
    out = pages.select("page", F.explode(g.fuse_sources(F.col("dom"), F.col("ocr"), F.col("vision"))).alias("e"))
    return out.select("page", "e.ref", "e.text", F.round("e.confidence", 9).alias("confidence"), "e.source")


C23 = f"""WITH {_BOXES}, e AS (SELECT page, ref AS n, 'c' || ref AS ref, CASE WHEN ref % 3 = 1 THEN '' ELSE tag END AS text, score, x1, y1, x2, y2 FROM b),
f AS (SELECT d.page, d.n,
   (SELECT arg_min(o.n, o.n) FROM e o WHERE o.page = d.page AND o.n % 3 = 2 AND {iou_sql('d', 'o')} >= 0.45) AS o,
   (SELECT arg_min(v.n, v.n) FROM e v WHERE v.page = d.page AND v.n % 3 = 0 AND {iou_sql('d', 'v')} >= 0.45) AS v FROM e d WHERE d.n % 3 = 1)
SELECT d.page, d.ref, CASE WHEN f.o IS NULL AND f.v IS NULL THEN '' ELSE coalesce(o.text, v.text, '') END AS text,
  round(CASE WHEN f.o IS NULL AND f.v IS NULL THEN d.score ELSE least(1.0, d.score * 0.55 + coalesce(o.score, 0) * 0.25 + coalesce(v.score, 0) * 0.2 + 0.1) END, 9) AS confidence,
  CASE WHEN f.o IS NULL AND f.v IS NULL THEN 'dom' ELSE 'fused' END AS source
FROM e d JOIN f ON f.page = d.page AND f.n = d.n LEFT JOIN e o ON o.page = d.page AND o.n = f.o LEFT JOIN e v ON v.page = d.page AND v.n = f.v
UNION ALL SELECT page, ref, text, round(score, 9), 'dom' FROM e WHERE n % 3 <> 1"""


def c24_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = g.opaque_mask(_corner(), F.lit(60.0), F.lit(50.0), 8, 8, True)
    return boxes(spark, sf_dir).select("page", "ref", made.alias("m")).filter("m is not null").select("page", "ref", "m.*")


C24 = f"""WITH {_BOXES}, a AS (SELECT page, ref, greatest(0, floor(x1 - 8)) AS l, greatest(0, floor(y1 - 8)) AS t, least(60, ceil(x2 + 8)) AS r, least(50, ceil(y2 + 8)) AS u,
  greatest(0, floor(x1)) AS core_x, greatest(0, floor(y1)) AS core_y, least(60, ceil(x2)) AS cr, least(50, ceil(y2)) AS cb FROM b),
m AS (SELECT page, ref, floor(l / 16) * 16 AS x, floor(t / 16) * 16 AS y, least(60, ceil(r / 16) * 16) AS r, least(50, ceil(u / 16) * 16) AS u, core_x, core_y, cr, cb FROM a)
SELECT page, ref, x, y, r - x AS width, u - y AS height, core_x, core_y, cr - core_x AS core_width, cb - core_y AS core_height FROM m WHERE r > x AND u > y AND cr > core_x AND cb > core_y"""


def c27_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda x, y, s: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(s).alias("scale_x"), F.lit(s).alias("scale_y"))
    top = g.in_top_frame(_xywh(), F.slice(F.array(frame(3.0, 4.0, 0.5), frame(10.0, 20.0, 2.0), frame(1.0, 1.0, 1.5)), F.lit(1), (F.col("ref") % 4).cast("int")))
    return boxes(spark, sf_dir).select("page", "ref", top.alias("t")).select("page", "ref", "t.*")


C27 = f"""WITH {_BOXES}, p1 AS (SELECT page, ref, CASE WHEN ref % 4 >= 1 THEN 3.0 + x * 0.5 ELSE x END AS x, CASE WHEN ref % 4 >= 1 THEN 4.0 + y * 0.5 ELSE y END AS y,
  CASE WHEN ref % 4 >= 1 THEN width * 0.5 ELSE width END AS w, CASE WHEN ref % 4 >= 1 THEN height * 0.5 ELSE height END AS h FROM b),
p2 AS (SELECT page, ref, CASE WHEN ref % 4 >= 2 THEN 10.0 + x * 2.0 ELSE x END AS x, CASE WHEN ref % 4 >= 2 THEN 20.0 + y * 2.0 ELSE y END AS y,
  CASE WHEN ref % 4 >= 2 THEN w * 2.0 ELSE w END AS w, CASE WHEN ref % 4 >= 2 THEN h * 2.0 ELSE h END AS h FROM p1)
SELECT page, ref, CASE WHEN ref % 4 >= 3 THEN 1.0 + x * 1.5 ELSE x END AS x, CASE WHEN ref % 4 >= 3 THEN 1.0 + y * 1.5 ELSE y END AS y,
  CASE WHEN ref % 4 >= 3 THEN w * 1.5 ELSE w END AS width, CASE WHEN ref % 4 >= 3 THEN h * 1.5 ELSE h END AS height FROM p2"""


def c29_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = g.preview_mask(_xywh(), F.lit(1.25), F.lit(0.75), F.lit(90.0), F.lit(60.0))
    return boxes(spark, sf_dir).select("page", "ref", made.alias("m")).select("page", "ref", "m.*")


C29 = f"""WITH {_BOXES} SELECT page, ref, greatest(0.0, floor(x * 1.25) - 2) AS x1, greatest(0.0, floor(y * 0.75) - 2) AS y1,
  least(90.0, ceil((x + width) * 1.25) + 2) AS x2, least(60.0, ceil((y + height) * 0.75) + 2) AS y2 FROM b"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = boxes(spark, sf_dir)
    truth = b.select("page", F.col("ref").alias("index"), "tag", _xywh().alias("box"))
    moved = F.struct((F.col("x") + F.col("part") % 3).alias("x"), "y", "width", "height")
    return truth, b.filter("part % 4 <> 0").select("page", F.col("ref").alias("index"), "tag", moved.alias("box"))


def _matched(tagged: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = m.match_boxes(*_sides(spark, sf_dir), "page", 0.5, tagged)
        return done.select("page", "tp", "fp", "fn", "mean_iou")

    return run


def _matched_sql(tagged: bool) -> str:
    return f"""WITH {_BOXES}, o AS (SELECT page, ref, tag, x1 + part % 3 AS x1, y1, x2 + part % 3 AS x2, y2 FROM b WHERE part % 4 <> 0),
c AS (SELECT t.page, t.ref AS ti, o.ref AS oi, {iou_sql('t', 'o')} AS v FROM b t JOIN o ON o.page = t.page {'AND o.tag = t.tag' if tagged else ''} AND {iou_sql('t', 'o')} >= 0.5),
l AS (SELECT page, list([{{'ti': ti, 'oi': oi, 'v': v}}] ORDER BY v DESC, ti, oi) AS xs FROM c GROUP BY page),
k AS (SELECT page, list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.ti = x[1].ti OR k.oi = x[1].oi)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM l),
n AS (SELECT page, count(*) AS nt FROM b GROUP BY page), q AS (SELECT page, count(*) AS no FROM o GROUP BY page)
SELECT n.page, coalesce(len(kept), 0) AS tp, coalesce(no, 0) - coalesce(len(kept), 0) AS fp, nt - coalesce(len(kept), 0) AS fn,
  floor(list_sum(list_transform(kept, lambda z: z.v)) / len(kept) * 10000 + 0.5) / 10000 AS mean_iou
FROM n LEFT JOIN q ON q.page = n.page LEFT JOIN k ON k.page = n.page"""


def f03_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, o = _sides(spark, sf_dir)
    fold = lambda d, n: d.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("index", F.struct(F.col("tag").alias("kind"), g.to_corners(F.col("box")).alias("box")).alias("v")))), lambda x: x["v"]).alias(n))
    joined = fold(t, "t").join(fold(o, "o"), "page", "left").withColumn("o", F.coalesce("o", F.slice("t", 1, 0)))
    n = joined.select("page", m.match_best(F.col("t"), F.col("o")).alias("matched"), F.size("t").alias("expected"), F.size("o").alias("detected"))
    p, r = m.percent(F.col("matched"), F.col("detected")), m.percent(F.col("matched"), F.col("expected"))
    return n.select("page", F.col("matched").cast("long").alias("matched"), p.alias("precision"), r.alias("recall")).withColumn("f1", m.f1_percent(F.col("precision"), F.col("recall")))


_HALF_UP = "floor(({}) * 100 + 0.5) / 100"
_SMALLER = f"{inter_sql('t', 'o')} / greatest(1.0, least({area_sql('t')}, {area_sql('o')}))"
F03 = f"""WITH {_BOXES}, o AS (SELECT page, ref, tag, x1 + part % 3 AS x1, y1, x2 + part % 3 AS x2, y2 FROM b WHERE part % 4 <> 0),
c AS (SELECT t.page, t.ref AS ti, o.ref AS oi, {_SMALLER} AS v FROM b t JOIN o ON o.page = t.page AND o.tag = t.tag AND {_SMALLER} >= 0.5),
l AS (SELECT page, list([{{'ti': ti, 'oi': oi}}] ORDER BY ti, v DESC, oi) AS xs FROM c GROUP BY page),
k AS (SELECT page, len(list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.ti = x[1].ti OR k.oi = x[1].oi)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS kept FROM l),
n AS (SELECT page, count(*) AS nt FROM b GROUP BY page), q AS (SELECT page, count(*) AS no FROM o GROUP BY page),
a AS (SELECT n.page, coalesce(kept, 0) AS matched, nt, coalesce(no, 0) AS no FROM n LEFT JOIN q ON q.page = n.page LEFT JOIN k ON k.page = n.page),
r AS (SELECT page, matched, CASE WHEN no > 0 THEN {_HALF_UP.format('matched * 100 / no')} ELSE 0.0 END AS precision, {_HALF_UP.format('matched * 100 / nt')} AS recall FROM a)
SELECT *, CASE WHEN precision + recall > 0 THEN {_HALF_UP.format('2 * precision * recall / (precision + recall)')} ELSE 0.0 END AS f1 FROM r"""


def f09_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of all boxes of each part and of the same boxes moved by up to two columns, on a picture of 100 by 70."""
    b = boxes(spark, sf_dir, by_page=False)
    moved = F.struct((F.col("x") + F.col("part") % 3).alias("x"), "y", "width", "height")
    page = F.col("part").alias("page")
    return m.mask_overlap(b.select(page, _xywh().alias("box")), b.select(page, moved.alias("box")), "page", 100, 70)


def _f09_sql() -> str:
    cells = "SELECT page, unnest(range(CAST(x AS BIGINT), least(100, CAST(ceil(x + w) AS BIGINT)))) AS x, y, h, bit FROM s"
    grid = f"SELECT page, x, unnest(range(CAST(y AS BIGINT), least(70, CAST(ceil(y + h) AS BIGINT)))) AS y, bit FROM ({cells})"
    return f"""WITH {_BOXES}, s AS (SELECT part AS page, x, y, width AS w, height AS h, 1 AS bit FROM b UNION SELECT part, x + part % 3, y, width, height, 2 FROM b),
c AS (SELECT page, x, y, bit_or(bit) AS m FROM ({grid}) GROUP BY page, x, y)
SELECT page, count(*) FILTER (m IN (1, 3)) AS expected, count(*) FILTER (m >= 2) AS redacted, count(*) FILTER (m = 3) AS both FROM c GROUP BY page"""


QUERIES = {
    "c01_iou": c01_iou, "c02_box_iou": c02_box_iou, "c04_smaller": c04_smaller, "c05_suppress": _suppressed(0.3, 4), "c06_detector_suppress": _suppressed(0.45, 64),
    "c09_scale": c09_scale, "c10_map_box": c10_map_box, "c11_surface": c11_surface, "c13_runs": c13_runs, "c03_forms": c03_forms, "c16_union": c16_union, "c16_united": c16_united, "c18_bounding": c18_bounding,
    "c19_outside": c19_outside, "c20_scope": c20_scope, "c21_covered": c21_covered, "c22_fuse": c22_fuse, "c23_sources": c23_sources, "c24_mask": c24_mask,
    "c27_frames": c27_frames, "c29_preview": c29_preview, "f01_match": _matched(True), "f02_match_untagged": _matched(False), "f03_best": f03_best, "f09_pixels": f09_pixels,
}
_C02 = f"WITH {_BOXES.replace(_W + ' AS width', 'CASE WHEN l_partkey % 5 = 0 THEN 0.0 ELSE ' + _W + ' END AS width').replace(f'{_X} + {_W} AS x2', f'CASE WHEN l_partkey % 5 = 0 THEN {_X} ELSE {_X} + {_W} END AS x2')} SELECT a.page, a.ref AS ra, c.ref AS rc, {iou_sql('a', 'c')} AS v FROM b a JOIN b c ON a.page = c.page AND a.ref < c.ref"
ORACLE = {
    "c01_iou": _PAIR_SQL.format(iou_sql("a", "c")), "c02_box_iou": _C02,
    "c04_smaller": _PAIR_SQL.format(f"{inter_sql('a', 'c')} / greatest(1.0, least({area_sql('a')}, {area_sql('c')}))"),
    "c05_suppress": _suppressed_sql(0.3, 4), "c06_detector_suppress": _suppressed_sql(0.45, 64), "c09_scale": C09, "c10_map_box": C10, "c11_surface": _surface_sql(),
    "c13_runs": C13, "c03_forms": C03, "c16_union": C16, "c16_united": C16_UNITED, "c18_bounding": C18, "c19_outside": C19, "c20_scope": C20, "c21_covered": C21, "c22_fuse": C22, "c23_sources": C23, "c24_mask": C24,
    "c27_frames": C27, "c29_preview": C29, "f01_match": _matched_sql(True), "f02_match_untagged": _matched_sql(False), "f03_best": F03, "f09_pixels": _f09_sql(),
}
