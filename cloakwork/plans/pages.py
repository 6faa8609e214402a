"""Queries over the scopes, texts and cards of pages.  Pages are written around tables' values by SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import observation, regions
from ..sources import html
from ..sources.tables import spread, table
from .privacy import PROBE, merged_ctes

_ID = "CAST(c_custkey AS STRING)"
_SECOND = f"CASE c_custkey % 3 WHEN 0 THEN 'Address: 12 Long Lane ' || {_ID} WHEN 1 THEN 'plain ' || c_mktsegment ELSE 'mail b' || {_ID} || '@c.example or d@e.example' END"
_THIRD = f"CASE c_custkey % 4 WHEN 0 THEN 'key CANARY_' || {_ID} ELSE 'nothing here' END"


def _escaped(text: str) -> str:
    return f"replace(replace({text}, '&', '&amp;'), '<', '&lt;')"


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph; a list entry in a shadow root; a paragraph in a frame; texts that no scan may see."""
    inner = f"'<html><body><p>' || {_escaped(_THIRD)} || '</p></body></html>'"
    framed = f"replace(replace({inner}, '&', '&amp;'), '\"', '&quot;')"
    page = (
        f"'<body><p>' || {_escaped(PROBE)} || '</p><iframe srcdoc=\"' || {framed} || '\">a@b.example</iframe><div><template shadowrootmode=\"open\"><ul><li>' || {_escaped(_SECOND)} || '</li></ul></template>"
        "<template>c@d.example</template></div><div><template shadowrootmode=\"closed\"><p>e@f.example</p></template></div><p hidden>g@h.example</p><script>i@j.example</script></body>'"
    )
    return spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("page_id"), F.expr(page).alias("html"))


_TEXTS = f"""texts AS (SELECT '0' AS src, c_custkey AS id, {PROBE} AS text FROM customer
 UNION ALL SELECT '1', c_custkey, {_THIRD} FROM customer UNION ALL SELECT '2', c_custkey, {_SECOND} FROM customer)"""


def s01_scoped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The redacted text of each page with its shadow root and frame."""
    return html.visible_text(html.nodes(_made(spark, sf_dir))).select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


_JOINED = f"texts AS (SELECT 'page' AS src, c_custkey AS id, trim(regexp_replace({PROBE} || ' ' || {_THIRD} || ' ' || {_SECOND}, '\\s+', ' ', 'g')) AS text FROM customer)"
S01 = f"""WITH {merged_ctes(_JOINED)},
p AS (SELECT t.id, t.text, m.start, m.stop, m.kind,
        coalesce(lag(m.stop) OVER (PARTITION BY t.id ORDER BY m.start), 0) AS before, lead(m.start) OVER (PARTITION BY t.id ORDER BY m.start) AS after
      FROM texts t LEFT JOIN merged m ON m.id = t.id),
r AS (SELECT id, string_agg(CASE WHEN start IS NULL THEN text ELSE substr(text, before + 1, start - before) || '[REDACTED_' || kind || ']'
        || CASE WHEN after IS NULL THEN substr(text, stop + 1) ELSE '' END END, '' ORDER BY start) AS t FROM p GROUP BY id)
SELECT id AS page_id, length(t) AS n_chars, sha256(t) AS sha256 FROM r"""

_LINE, _CHAR, _HIGH = 40, 7.0, 12.0


def _runs(nodes: DataFrame) -> DataFrame:
    """Boxes of lines of 40 characters, as a layout would give them."""
    texts = nodes.select("page_id", "node", F.explode("texts").alias("t")).select("page_id", "node", "t.*")
    rows = texts.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / _LINE).cast("int"))))
    start = F.col("i") * _LINE
    end = F.least(F.length("text"), start + _LINE)
    return rows.select(
        "page_id", "node", "place", start.alias("start"), end.alias("end"), F.lit(10.0).alias("x"), (F.col("place") * 100.0 + F.col("i") * _HIGH).alias("y"),
        ((end - start) * _CHAR).alias("width"), F.lit(_HIGH).alias("height"),
    )


def a35_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of private text; pages of which a part can't be masked as one blocked row."""
    nodes = html.nodes(_made(spark, sf_dir))
    shown = nodes.filter((F.size("texts") > 0) & F.col("shown"))
    return regions.text_regions(html.scoped(nodes), _runs(shown), 300.0, 120.0, strict=True)


#: Texts are placed in the order of the page, but scopes come level by level: the frame's before the shadow root's.
A35 = f"""WITH {merged_ctes(_TEXTS)},
places AS (SELECT *, CAST(src AS INTEGER) AS place, src = '2' AS listed, src = '1' AS framed FROM texts),
runs AS (SELECT id, src, place, i * {_LINE} AS a, least(length(text), i * {_LINE} + {_LINE}) AS b, place * 100.0 + i * {_HIGH} AS y FROM (SELECT *, unnest(range((length(text) - 1) // {_LINE} + 1)) AS i FROM places)),
blocks AS (SELECT id, src, min(y) AS y, max((b - a) * {_CHAR}) AS width, max(y) + {_HIGH} - min(y) AS height FROM runs GROUP BY id, src),
spans AS (SELECT m.id, m.src, m.start, m.stop, m.kind, (p.listed OR p.src IN ('0', '1')) AND m.kind = 'ADDRESS' AS whole, p.framed FROM merged m JOIN places p ON p.id = m.id AND p.src = m.src),
boxes AS (
  SELECT s.id, s.kind, s.whole, CASE WHEN s.framed THEN 10.0 ELSE 10.0 + (greatest(s.start, r.a) - r.a) * {_CHAR} END AS x, CASE WHEN s.framed THEN k.y ELSE r.y END AS y,
    CASE WHEN s.framed THEN k.width ELSE (least(s.stop, r.b) - greatest(s.start, r.a)) * {_CHAR} END AS width, CASE WHEN s.framed THEN k.height ELSE {_HIGH} END AS height
  FROM spans s JOIN runs r ON r.id = s.id AND r.src = s.src AND s.start < r.b AND r.a < s.stop JOIN blocks k ON k.id = s.id AND k.src = s.src WHERE NOT s.whole
  UNION ALL SELECT s.id, s.kind, true, 10.0, k.y, k.width, k.height FROM spans s JOIN blocks k ON k.id = s.id AND k.src = s.src WHERE s.whole),
bad AS (SELECT id, bool_or(whole AND width * height > {regions.LARGEST_BLOCK} * 300 * 120) AS blocked FROM boxes GROUP BY id)
SELECT id AS page_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, kind FROM boxes JOIN bad USING (id) WHERE NOT blocked
UNION ALL SELECT id, NULL, NULL, NULL, NULL, 'BLOCKED' FROM bad WHERE blocked"""


def d14_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards around every page's HTML: a result with all evidence, an advertised one with less, twice the same key, and a hidden one."""
    key = "'K' || lpad(CAST(page_id AS STRING), 9, '0')"
    card = f"""'<div data-component-type="s-search-result" data-asin="' || {key} || '"><h2><a href="https://www.amazon.in/x/dp/' || {key} || '/r"><span>Laptop ' || CAST(page_id AS STRING) || '</span> 16 GB</a></h2>'
      || '<span class="x a-price"><span class="a-offscreen">INR ' || CAST(page_id * 10 AS STRING) || ',000.50</span></span>' || CASE WHEN page_id % 2 = 0 THEN '<i aria-label="4.5 out of 5 stars"></i> 1,234 ratings' ELSE '' END || '</div>'"""
    second = f"""'<div data-asin="' || {key} || '"><h2>A much longer title of the same key</h2></div><div data-asin="s' || lpad(CAST(page_id AS STRING), 9, '0') || '"><b>Sponsored</b><h2>' || CASE WHEN page_id % 3 = 0 THEN 'ask a@b.example' ELSE 'Stand' END || '</h2></div>'"""
    hidden = "'<div hidden><div data-asin=\"H000000000\"><h2>Hidden</h2></div></div><div data-asin=\"short\"></div>'"
    rows = spread(table(spark, sf_dir, "pages")).select("page_id", F.concat(F.expr(second), F.expr(card), F.expr(hidden), "html").alias("html"))
    return html.product_cards(html.nodes(rows, html.CARD_MARKS))


D14 = """SELECT page_id, 'K' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS key, 'Laptop ' || page_id || ' 16 GB' AS title, CASE WHEN page_id = 0 THEN 0.5 ELSE page_id * 10000 + 0.5 END::DOUBLE AS price,
  CASE WHEN page_id % 2 = 0 THEN 4.5::DOUBLE END AS rating, CASE WHEN page_id % 2 = 0 THEN 1234 END AS rating_count, 'https://www.amazon.in/dp/K' || lpad(CAST(page_id AS VARCHAR), 9, '0') AS url, false AS sponsored, 1 AS position, 1.0::DOUBLE AS confidence FROM pages
UNION ALL SELECT page_id, 'S' || lpad(CAST(page_id AS VARCHAR), 9, '0'), CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Stand' END, NULL, NULL, NULL, '', true, 3, CASE WHEN page_id % 3 = 0 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END FROM pages"""


def n01_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of a page, its shadow root and its frame, level by level."""
    page = f"""'<a href="/a">' || {_escaped('c_name')} || '</a><div role="button" title="go"></div><input type="hidden"><div style="display:none"><button>x</button></div>'
      || '<x-y><template shadowrootmode="open"><select></select>' || CASE WHEN c_custkey % 2 = 0 THEN '<iframe srcdoc="&lt;textarea aria-label=&quot;note&quot;&gt;&lt;/textarea&gt;"></iframe>' ELSE '' END || '</template></x-y>'
      || '<iframe src="https://other.example"></iframe><iframe srcdoc="&lt;summary&gt;s&lt;/summary&gt;"></iframe><p contenteditable="true"></p>'"""
    rows = spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("page_id"), F.expr(page).alias("html"))
    return html.controls(html.nodes(rows)).select("page_id", F.col("place").cast("long").alias("place"), "scope", "tag", "label")


N01 = """SELECT c_custkey AS page_id, n AS place, scope, tag, label FROM customer, (VALUES (1, 'top', 'a', ''), (2, 'top', 'div', 'go'), (3, 'top', 'p', ''), (4, 'top/shadow1', 'select', ''), (5, 'top/frame2', 'summary', ''),
  (6, 'top/shadow1/frame1', 'textarea', 'note')) v(n, scope, tag, label) WHERE n < 6 OR c_custkey % 2 = 0"""

def n02_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's row: names of controls, regions and text without private spans, counts of kinds, fingerprints."""
    page = f"""'<html><head><title>Page of ' || {_ID} || '</title></head><body><h1>Welcome</h1><p>' || {_escaped(PROBE)} || '</p><button aria-label="Segment">' || c_mktsegment || '</button>'
      || '<input type="email" placeholder="Your email"><a href="/x">write to a1@b.example</a><div><template shadowrootmode="open"><button role="tab">deep</button></template></div><p hidden>x@y.example</p></body></html>'"""
    rows = spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("page_id"), F.expr(page).alias("html"))
    seen = observation.observe(html.scoped(html.nodes(rows)), html.is_control())
    listed = lambda column, *fields: F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[f] for f in fields])), "|")
    counts = F.array_join(F.transform(F.map_entries("pii_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return seen.select("page_id", "title", F.sha2("text", 256).alias("text_sha256"), listed("elements", "ref", "tag", "role", "name", "sensitive_type", "frame_path").alias("elements"), listed("regions", "id", "role", "text").alias("regions"), counts.alias("counts"), "fingerprint", "meaningful")


_SEEN = f"""texts AS (SELECT 'p' AS src, c_custkey AS id, {PROBE} AS text FROM customer
 UNION ALL SELECT 'page', c_custkey, trim(regexp_replace('Welcome ' || {PROBE} || ' ' || c_mktsegment || ' write to a1@b.example deep', '\\s+', ' ', 'g')) FROM customer)"""
N02 = rf"""WITH {merged_ctes(_SEEN)},
p AS (SELECT t.src, t.id, t.text, m.start, m.stop, m.kind, coalesce(lag(m.stop) OVER w, 0) AS before, lead(m.start) OVER w AS after
      FROM texts t LEFT JOIN merged m ON m.id = t.id AND m.src = t.src WINDOW w AS (PARTITION BY t.src, t.id ORDER BY m.start)),
r AS (SELECT src, id, string_agg(CASE WHEN start IS NULL THEN text ELSE substr(text, before + 1, start - before) || '[REDACTED_' || kind || ']'
        || CASE WHEN after IS NULL THEN substr(text, stop + 1) ELSE '' END END, '' ORDER BY start) AS t FROM p GROUP BY src, id),
k AS (SELECT id, kind, count(*) AS n FROM (SELECT id, kind FROM merged WHERE src = 'page' UNION ALL SELECT c_custkey, 'EMAIL' FROM customer, range(2)) GROUP BY id, kind),
counted AS (SELECT id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS counts FROM k GROUP BY id),
f AS (SELECT c_custkey AS id, 'button::Segment ' || c_mktsegment || '|input::[REDACTED_EMAIL]|a::write to [REDACTED_EMAIL]|button:tab:deep' AS f FROM customer)
SELECT c_custkey AS page_id, 'Page of ' || c_custkey AS title, sha256(w.t) AS text_sha256,
  'c1:button::Segment ' || c_mktsegment || '::top|c2:input::[REDACTED_EMAIL]:email:top|c3:a::write to [REDACTED_EMAIL]::top|c4:button:tab:deep::top/shadow1' AS elements,
  't1:heading:Welcome|t2:text:' || trim(regexp_replace(v.t, '\s+', ' ', 'g')) AS regions, counts,
  printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(f, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) AS fingerprint, true AS meaningful
FROM customer JOIN r w ON w.id = c_custkey AND w.src = 'page' JOIN r v ON v.id = c_custkey AND v.src = 'p' JOIN counted ON counted.id = c_custkey JOIN f ON f.id = c_custkey"""

QUERIES = {"a35_regions": a35_regions, "d14_cards": d14_cards, "n01_controls": n01_controls, "n02_observation": n02_observation, "s01_scoped_text": s01_scoped_text}
ORACLE = {"a35_regions": A35, "d14_cards": D14, "n01_controls": N01, "n02_observation": N02, "s01_scoped_text": S01}
