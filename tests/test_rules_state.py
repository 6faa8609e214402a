"""Rules, selection, state (batch and stream), contracts, pages and model glue."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import contracts as c
from cloakwork.operators import model_glue as h
from cloakwork.operators import rules as r
from cloakwork.operators import selection as s
from cloakwork.operators import state
from cloakwork.sources import html
from cloakwork.streaming import limits


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "reason"),
    [("captcha shown", "CAPTCHA"), ("HTTP 429", "RATE_LIMIT"), ("Target not found", "ELEMENT_NOT_FOUND"), ("timed out", "PAGE_LOADING"), ("no safe result", "NO_RESULT"), ("odd", "UNKNOWN")],
)
def test_failures(spark, text, reason):
    assert one(spark, r.classify_failure(F.lit(text))) == reason


@pytest.mark.parametrize(
    ("task", "command"),
    [("Hey Robo, could you please open YouTube, thanks!", "open YouTube"), ("please please look up x.", "look up x"), (None, ""), ("robot arm", "robot arm")],
)
def test_commands(spark, task, command):
    assert one(spark, r.normalise_command(F.lit(task).cast("string"), "robo")) == command


def test_addresses(spark):
    for typed, url in [("example dot com", "https://example.com/"), ("HTTP://A.test/x?y", "http://a.test/x?y"), ("wikipedia", None), ("https://u:p@a.test", None)]:
        assert one(spark, r.explicit_url(F.lit(typed))) == url
    assert one(spark, r.domain_label(F.lit("www.my-shop.co.uk"))) == "myshop"
    assert one(spark, r.domain_label(F.lit("python.attacker.example"))) == "attacker"


def test_hash_of_characters_outside_the_basic_plane(spark):
    def mirror(text):
        h_ = 2166136261
        for ch in text:
            unit = int.from_bytes(ch.encode("utf-16-be")[:2], "big")
            h_ = ((h_ ^ unit) * 16777619) % 2**32
        return f"{h_:08x}"

    for text in ("", "abc", "é\U0001f512x"):
        assert one(spark, r.fnv1a(F.lit(text))) == mirror(text)


def test_candidate_selection(spark):
    key = "B0ABCDEFGH"
    row = lambda place, title, price, conf, sponsored=False, pos=1.0: (place, key, title, price, "INR", 4.0, 10.0, f"https://amazon.in/dp/{key}", sponsored, pos, conf, "c1", "")
    kind = "place long, key string, title string, price double, currency string, rating double, rating_count double, url string, sponsored boolean, position double, confidence double, ref string, availability string"
    rows = spark.createDataFrame([row(1, "Acer laptop", 50000.0, 0.8), row(2, "Acer laptop 8 GB RAM", 49000.0, 0.9), row(3, "HP laptop", 50001.0, 0.9), row(4, "Laptop bag", 900.0, 0.9), row(5, "x laptop", 1.0, 0.9, True)], kind)
    norm = s.normalise_candidates(rows)
    best = s.select_candidates(norm, F.lit(50000.0)).collect()
    assert [(b.key, b.place, b.rank) for b in best] == [(key, 2, 1)]
    assert {x.reason: x.n for x in s.rejection_counts(norm, F.lit(50000.0), []).collect()} == {"price": 1, "productType": 1, "sponsored": 1}


def limiter(events, limit, window):
    out, started, count = {}, {}, {}
    for key, event, t in sorted(events, key=lambda e: (e[2], e[1])):
        if key not in started or t - started[key] >= window:
            started[key], count[key] = t, 0
        count[key] += 1
        out[event] = (count[key] <= limit, max(0, limit - count[key]))
    return out


def test_rate_limit_example_and_mirror(spark):
    kind = "user_id long, event_id long, t long"
    rows = spark.createDataFrame([(1, 1, 1000), (1, 2, 1000), (1, 3, 1000), (2, 4, 1000), (1, 5, 1101)], kind)
    got = {x.event_id: x.allowed for x in state.rate_limit(rows, "user_id", "t", "event_id", 2, 100).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}
    rng = random.Random(1)
    events = [(rng.randint(1, 5), i, rng.randint(0, 3000)) for i in range(400)]
    got = {x.event_id: (x.allowed, x.remaining) for x in state.rate_limit(spark.createDataFrame(events, kind), "user_id", "t", "event_id", 3, 250).collect()}
    assert got == limiter(events, 3, 250)


def streamed(spark, tmp_path, rows, made, name):
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = made(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_streamed_rate_limit_is_the_batch_result(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.randint(1, 4), i, rng.randint(0, 2000)) for i in range(120)]
    rows = spark.createDataFrame(events, "user_id long, event_id long, t long").coalesce(1)
    got = streamed(spark, tmp_path, rows, lambda d: limits.rate_limited(d, 2, 300), "limited")
    assert {x.event_id: (x.allowed, x.remaining) for x in got} == limiter(events, 2, 300)


def test_streamed_session_tokens(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 1, "EMAIL", "a"), (1, 2, 2, "EMAIL", "b"), (1, 3, 3, "EMAIL", "a"), (2, 4, 1, "PHONE", "a")], "session long, event_id long, t long, kind string, raw string").coalesce(1)
    got = streamed(spark, tmp_path, rows, limits.session_tokens, "tokens")
    assert {x.event_id: x.token for x in got} == {1: "[EMAIL_1]", 2: "[EMAIL_2]", 3: "[EMAIL_1]", 4: "[PHONE_1]"}


def test_streamed_failures(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 1, "x"), (1, 2, 2, "x"), (1, 3, 3, "y"), (2, 4, 1, "x")], "user_id long, event_id long, t long, signature string").coalesce(1)
    got = streamed(spark, tmp_path, rows, limits.failure_memory, "failures")
    assert {x.event_id: (x.repeated, x.exhausted) for x in got} == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, False)}


def test_contract_texts_and_urls(spark):
    for url, ok in [("https://a.test/x", True), ("about:blank", True), ("https://a.test/?q", False), ("https://a.test/%2540", False), ("https://a.test/../x", False), ("https://a.test/a@b.co", False)]:
        assert (one(spark, c.safe_url(F.lit(url))) is not None) == ok, url
    for text, ok in [("plain", True), ("a\x07b", False), ("mail a@b.co", False), ("see https://a.test/?x=1", False), ("x" * 301, False)]:
        assert (one(spark, c.safe_text(F.lit(text))) is not None) == ok, text


def test_page_nodes_links_and_texts(spark):
    page = '<html><body><script>a@b.co</script><p>mail x@y.org <b>now</b></p><a href="/1">One</a><a href="/1">Again</a><a href="/2">Two<br></a></body></html>'
    nodes = html.nodes(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"))
    assert [(x.href, x.title) for x in html.links(nodes).orderBy("place").collect()] == [("/1", "One"), ("/2", "Two")]
    assert [(x.kind, x["index"]) for x in html.private_texts(nodes).collect()] == [("email", 5)]


def test_wordpiece(spark):
    known = {"[UNK]": 0, "[CLS]": 1, "[SEP]": 2, "play": 3, "##ing": 4, "!": 5}
    row = spark.createDataFrame([(["playing", "zz!"],), (["é"],)], "w array<string>").select(h.encode_words(F.col("w"), known).alias("e")).collect()
    assert row[0].e.ids == [1, 3, 4, 0, 5, 2] and row[0].e.words == [-1, 0, 0, 1, 1, -1]
    assert row[1].e.ids is None


def test_rate_limit_of_a_key_with_a_million_events(spark):
    """Windows of a hot key against a plain fold, and other keys, null too, beside it."""
    hot = spark.range(1_000_000).selectExpr("id", "'hot' AS k", "id * 7 AS t")
    few = spark.createDataFrame([(-1, None, 5), (-2, None, 6), (-3, "a", 0), (-4, "a", None)], "id long, k string, t long")
    rows = state.rate_limit(hot.unionByName(few), "k", "t", "id", 3, 100)
    begun, seen, allowed, wait = 0, 0, 0, 0
    for t in range(0, 7_000_000, 7):
        if t - begun >= 100:
            begun, seen = t, 0
        seen += 1
        allowed += seen <= 3
        wait += 100 - (t - begun) if seen > 1 else 0
    got = rows.filter("k = 'hot'").selectExpr("count(*)", "count_if(allowed)", "sum(retry_after_ms)").first()
    assert tuple(got) == (1_000_000, allowed, wait)
    others = {r.id: (r.allowed, r.remaining, r.retry_after_ms) for r in rows.filter("k IS NULL OR k = 'a'").collect()}
    assert others == {-1: (True, 2, None), -2: (True, 1, 99), -3: (True, 2, None)}


def test_costly_columns_are_evaluated_once_for_each_candidate(spark):
    """A filter on the reason isn't pushed below what it is made of, and an address is parsed for its host and path alone."""
    kind = "key string, title string, price double, currency string, rating double, rating_count double, url string, sponsored boolean, position int, confidence double, ref string, availability string, grp int, place int"
    urls = ["https://www.amazon.in/dp/K000000001", "https://u:p@amazon.in/dp/K000000001", "https://@amazon.in/dp/K000000001", "HTTPS://amazon.in:443/dp/K000000001?q=a@b", "http://amazon.in/dp/K000000001", "https://amazon.in /dp/K000000001"]
    rows = s.normalise_candidates(spark.createDataFrame([("K000000001", "Acer laptop 8 GB", 5.0, "INR", 4.0, 2.0, u, False, 1, 0.9, "c1", "", 1, i) for i, u in enumerate(urls)], kind))
    assert [r["url"] != "" for r in rows.orderBy("place").collect()] == [True, False, False, True, False, False]
    counted = s.rejection_counts(rows, F.lit(10.0), ["grp"])
    assert counted.collect() == [(1, "identity", 4)]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_url") + plan.count("parse_url") <= 4 and "Generate" in plan
