"""Scopes, ranges, cards and private regions of pages by literal expectations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import regions
from cloakwork.plans import pages as plans
from cloakwork.sources import html

PAGE = """<body><div id=a><template shadowrootmode=open><p>one</p><x-b><template shadowrootmode="open"><button>deep</button></template></x-b>
<template><p>inert</p></template></template><p>light</p></div><iframe src="https://else.example"></iframe>
<iframe srcdoc="&lt;p&gt;framed &lt;b&gt;bold&lt;/b&gt; end&lt;/p&gt;&lt;iframe srcdoc='&amp;lt;a&amp;gt;inner&amp;lt;/a&amp;gt;'&gt;&lt;/iframe&gt;">fallback<p>not here</p></iframe>
<div><template shadowrootmode="closed"><p>closed</p></template></div><section aria-hidden="true"><p>hidden</p></section><p>last"""


def rows(spark, page, marks=()):
    return html.nodes(spark.createDataFrame([(1, page)], "page_id long, html string"), marks)


def test_scopes_and_ranges(spark):
    got = {r.node: r for r in rows(spark, PAGE).collect()}
    texts = {t.text.strip(): r for r in got.values() for t in r.texts if t.text.strip()}
    assert set(texts) == {"one", "deep", "light", "framed", "bold", "end", "inner", "hidden", "last"}
    assert {t: r.scope for t, r in texts.items()} == {
        "one": "top/shadow1", "deep": "top/shadow1/shadow1", "light": "top", "framed": "top/frame2", "bold": "top/frame2", "end": "top/frame2", "inner": "top/frame2/frame1", "hidden": "top", "last": "top",
    }
    assert not texts["hidden"].shown and texts["last"].shown
    children = {}
    for r in got.values():
        children.setdefault(r.parent, []).append(r.node)

    def inside(n):
        return [n, *(x for c in children.get(n, []) for x in inside(c))]

    for n, r in got.items():
        assert sorted(inside(n)) == list(range(n, r.last + 1))
    order = [r.scope for r in html.scoped(rows(spark, PAGE)).select("scope", "scope_place").distinct().orderBy("scope_place").collect()]
    assert order == ["top", "top/shadow1", "top/frame2", "top/shadow1/shadow1", "top/frame2/frame1"]


def test_scopes_are_bounded(spark):
    page = "<div></div>" * 2499 + "".join(f'<iframe srcdoc="<p>f{i}</p>"></iframe>' for i in range(30))
    found = rows(spark, page)
    assert sorted(r.text for r in found.filter("tag = 'p' and reached").collect()) == ["f0"]  # the 2,500th element holds the last scope that is looked for
    many = rows(spark, "".join(f'<iframe srcdoc="<p>f{i}</p>"></iframe>' for i in range(30)))
    assert [r.text for r in html.scoped(many).filter("tag = 'p'").orderBy("node").collect()] == [f"f{i}" for i in range(15)]
    assert html.nodes(spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")).count() == 0


def test_unclosed_and_stray_tags(spark):
    got = {r.node: r for r in rows(spark, "<a><b>x</a>y</b></i><p>z").collect()}
    assert [(r.tag, r.last, r.text) for r in (got[n] for n in sorted(got))] == [("a", 1, ""), ("b", 1, "x"), ("p", 2, "z")]


def test_cards_are_parsed_once_and_not_joined(spark):
    plan = plans.d14_cards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_nested_cards_and_ties(spark):
    page = """<div data-asin="AAAAAAAAAA"><h2>Outer <b>title</b></h2><div data-asin="bbbbbbbbbb" data-component-type="s-search-result"><span role=heading>Inner</span><span data-a-color=price aria-label="₹1,000"></span>
      <a href="https://amazon.in/gp/product/BBBBBBBBBB?x=1" aria-label="link"></a></div></div><div data-asin="AAAAAAAAAA"><h2>Outer</h2></div>"""
    got = {r.key: r for r in html.product_cards(rows(spark, page, html.CARD_MARKS)).collect()}
    assert set(got) == {"AAAAAAAAAA", "BBBBBBBBBB"}
    inner, outer = got["BBBBBBBBBB"], got["AAAAAAAAAA"]
    assert (inner.title, inner.price, inner.url, inner.position, inner.confidence) == ("Inner", 1000.0, "https://www.amazon.in/dp/BBBBBBBBBB", 1, 1.0)
    assert (outer.title, outer.price, outer.url, outer.position, outer.confidence) == ("Outer title", 1000.0, "", 2, 0.6)


def layout(nodes, high=10.0):
    """A box for each text, as wide as it has characters."""
    texts = nodes.select("page_id", "node", F.explode("texts").alias("t"))
    return texts.select("page_id", "node", F.col("t.place").alias("place"), F.lit(0).alias("start"), F.length("t.text").alias("end"), F.lit(0.0).alias("x"), F.col("t.place") * 20.0, F.length("t.text") * 1.0, F.lit(high)).toDF(
        "page_id", "node", "place", "start", "end", "x", "y", "width", "height"
    )


def test_regions_of_spans(spark):
    found = html.scoped(rows(spark, "<p>see a@b.example</p><p>Address: 5 Long Lane</p><p hidden>c@d.example</p>"))
    got = sorted((r.kind, r.x, r.y, r.width, r.height) for r in regions.text_regions(found, layout(found), 1000, 1000).collect())
    assert got == [("ADDRESS", 9.0, 20.0, 11.0, 10.0), ("EMAIL", 4.0, 0.0, 11.0, 10.0)]
    strict = sorted((r.kind, r.x, r.y, r.width, r.height) for r in regions.text_regions(found, layout(found), 1000, 1000, True).collect())
    assert strict == [("ADDRESS", 0.0, 20.0, 20.0, 10.0), ("EMAIL", 4.0, 0.0, 11.0, 10.0)]
    assert [(r.kind, r.x) for r in regions.text_regions(found, layout(found), 20, 20, True).collect()] == [("BLOCKED", None)]


def test_a_long_span_meets_each_run_once(spark):
    key = "-----BEGIN PRIVATE KEY----- " + "abcd " * 100 + "-----END PRIVATE KEY-----"
    found = html.scoped(rows(spark, f"<p>{key}</p>"))
    size = len(key)
    runs = spark.createDataFrame([(1, 0, 0, a, min(size, a + 100), 0.0, float(a), float(min(size, a + 100) - a), 5.0) for a in range(0, size, 100)], "page_id long, node int, place int, start int, end int, x double, y double, width double, height double")
    got = regions.text_regions(found, runs, 1000, 1000).collect()
    assert sorted(r.y for r in got) == [float(a) for a in range(0, size, 100)] and sum(r.width for r in got) == size


@pytest.mark.parametrize("strict", [False, True])
def test_budgets_and_spans_without_boxes(spark, monkeypatch, strict):
    monkeypatch.setattr(regions, "MAX_INSPECTED", 3)
    found = html.scoped(rows(spark, "<p> </p>" * 5 + "<p>a@b.example</p>" * 5))
    got = [r.kind for r in regions.text_regions(found, layout(found), 1000, 1000, strict).collect()]
    assert got == (["BLOCKED"] if strict else ["EMAIL"] * 3)
    monkeypatch.setattr(regions, "MAX_INSPECTED", 100)
    flat = layout(found, 0.5)
    assert [r.kind for r in regions.text_regions(found, flat, 1000, 1000, strict).collect()] == (["EMAIL"] * 5 if strict else [])
    monkeypatch.setattr(regions, "MAX_REGIONS", 2)
    assert [r.kind for r in regions.text_regions(found, layout(found), 1000, 1000, strict).collect()] == (["BLOCKED"] if strict else ["EMAIL"] * 2)
