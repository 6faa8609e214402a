"""Mixing and sharding: targets, whole coverage, bounds, reruns and edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import mixing, sharding

from . import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Shares by weight, stopped at twice the size, the excess shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        share = {s: left * weight[s] / total for s in names if s not in full} if total else {}
        over = {s for s in share if share[s] >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mix_report(spark):
    data = corpus.rows()
    got = mixing.mix_report(corpus.frame(spark, data)).collect()
    assert len(got) == len(data)
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in data}
    sizes: dict = defaultdict(int)
    for i, t, _, source, *_ in data:
        sizes[source] += len(WORD.findall(t or ""))
    want = targets(sizes)
    source_of = {i: source for i, _, _, source, *_ in data}
    taken: dict = defaultdict(int)
    for r in got:
        source = source_of[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    for source, n in taken.items():
        assert n == int(want[source] + 1e-9)
    again = mixing.mix_report(corpus.frame(spark, data).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def _sizes(kind: str) -> dict[str | None, int]:
    rng = random.Random(kind)
    if kind == "equal":
        return {f"s{i}": 100 for i in range(20)}
    if kind == "alike":
        return {f"s{i}": 90 + rng.randrange(20) for i in range(20)}
    if kind == "steep":
        return {f"s{i}": 3**i % 100_003 for i in range(12)} | {None: 7}
    if kind == "empty ones":
        return {f"s{i}": rng.choice([0, 0, 5, 800]) for i in range(15)}
    if kind == "one":
        return {"s": 10}
    return {f"{rng.choice('aZé')}{i}": int(10 ** rng.uniform(0, 5)) for i in range(rng.randint(2, 40))} | {None: rng.randint(1, 5000)}


KINDS = ["equal", "alike", "steep", "empty ones", "one", *[f"random {i}" for i in range(6)]]


@pytest.mark.parametrize("kind", KINDS)
def test_targets_against_the_contracts_loop(spark, kind):
    sizes = _sizes(kind)
    key = lambda s: "" if s is None else f"+{s}"
    table = spark.createDataFrame([(key(s), n) for s, n in sizes.items()], "_source string, source_size long").repartition(5)
    got = {r._source: r.target for r in mixing.source_targets(table).collect()}
    want = targets(sizes)
    assert got == {key(s): pytest.approx(t) for s, t in want.items()}
    assert all(0 <= got[key(s)] <= 2 * n for s, n in sizes.items())
    assert sum(got.values()) == pytest.approx(min(1.5 * sum(sizes.values()), 2 * sum(sizes.values())))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, s, "w " * n) for i, (s, n) in enumerate(sizes.items())])
    by_sql = dict(con.execute(f"SELECT doc_id, target FROM ({mixing.ORACLE})").fetchall())
    assert by_sql == {i: pytest.approx(want[s]) for i, s in enumerate(sizes)}


def _copies_of(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def test_mixed_documents_against_brute_force(spark):
    """Twenty sources, one hot, with repeated rows that differ only in a column that isn't asked for, and a long text."""
    rng = random.Random(3)
    data = [(i, "w " * rng.randint(1, 60), None, f"s{rng.randrange(20)}", i, "", "", "") for i in range(300)]
    data += [(None, "same words here", None, "hot", i, "", "", "") for i in range(150)]
    data += [(None, "same words here", None, "hot", 7, "", "", "") for i in range(50)]
    data += [(9000, "long " * 40_000, None, "long", 1, "", "", ""), (9001, None, None, "s1", 1, "", "", ""), (9002, "", None, None, 1, "", "", "")]
    sizes: dict = defaultdict(int)
    for _, t, _, source, *_ in data:
        sizes[source] += len((t or "").split())
    want = targets(sizes)
    docs = corpus.frame(spark, data)
    mixed = mixing.mix_documents(docs).collect()
    words: dict = defaultdict(int)
    for r in mixed:
        words[r.source] += len(r.text.split())
    biggest: dict = defaultdict(int)
    for _, t, _, source, *_ in data:
        biggest[source] = max(biggest[source], len((t or "").split()))
    assert set(words) == {s for s in sizes if sizes[s]}
    for source, n in words.items():
        assert abs(n - want[source]) <= biggest[source] / 2 + 1
    assert max(Counter((r.doc_id, r.n_chars) for r in mixed if r.doc_id is not None).values()) <= 2
    hot = Counter(r.n_chars for r in mixed if r.source == "hot")
    assert max(n for c, n in hot.items() if c != 7) - min(hot[i] for i in range(150) if i != 7) <= 1
    again = mixing.mix_documents(docs.repartition(9)).collect()
    assert _copies_of(mixed) == _copies_of(again)
    report = mixing.mix_report(docs).collect()
    taken: dict = defaultdict(int)
    for r in report:
        taken[r.source_size, r.target] += r.taken
    assert len(report) == len(data)
    for (_, target), n in taken.items():
        assert n % int(target or 1) == 0 or n == int(target)


def test_mix_takes_rows_with_maps(spark):
    docs = corpus.frame(spark).withColumn("tags", F.create_map(F.lit("a"), F.col("lang")))
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_documents(docs).count() > 0


def test_pieces_read_each_slot_once_and_in_order(spark):
    lined, pieces = mixing.schedule(corpus.frame(spark), block=16)
    slots = defaultdict(int)
    for p in pieces.collect():
        slots[p.slot] += p.words
        assert p.words > 0 and p.first_word >= 0
    assert max(slots.values()) <= 16
    sources = {p.slot: p._source for p in pieces.collect()}
    order = [sources[s] for s in sorted(sources)]
    share = Counter(order)
    half = Counter(order[: len(order) // 2])
    for source, n in share.items():  # evenly spread: half of a source's slots stand in the first half
        assert abs(half[source] - n / 2) <= 3


def test_mixed_documents_keep_columns(spark):
    mixed = mixing.mix_documents(corpus.frame(spark))
    assert mixed.columns == corpus.frame(spark).columns
    assert mixed.filter("trim(text) = '' or text is null").count() == 0


def test_mix_of_nothing(spark):
    assert mixing.mix_report(corpus.empty(spark)).count() == 0
    assert mixing.mix_documents(corpus.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None, "", "", "")], corpus.SCHEMA)
    assert [(r["size"], r.target, r.taken) for r in mixing.mix_report(blank).collect()] == [(0, 0.0, 0)]


def test_shard_report(spark):
    data = corpus.rows()
    got = sharding.shard_report(corpus.frame(spark, data)).collect()
    assert len(got) == len(data)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(24))
    loads = [counts.get(i, 0) for i in range(24)]
    assert max(loads) - min(loads) <= 1
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    text = {i: (t or "").encode() for i, t, *_ in data}
    for r in got:
        assert r["size"] == len(text[r.doc_id]) + 8 and r.text_crc32 == crc32(text[r.doc_id])
    again = sharding.shard_report(corpus.frame(spark, data).repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_shards_keep_columns_and_take_one_key_for_many_rows(spark):
    rows = spark.createDataFrame([(7, f"t{i}") for i in range(200)], "doc_id long, text string")
    out = sharding.shard(rows, 4).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [50] * 4
    assert sharding.shard(corpus.empty(spark).drop("slot"), 4).count() == 0


def test_overflow_continues_clockwise_and_few_rows_move():
    nodes = [(10, 0), (20, 1), (30, 2)]
    plan = sharding.plan_ring({5: 10, 25: 2}, nodes, [4, 4, 4])
    assert plan == [(5, 0, 4, 0, 0), (25, 0, 2, 2, 0), (5, 4, 8, 1, 0), (5, 8, 10, 2, 2)]
    with pytest.raises(ValueError):
        sharding.plan_ring({5: 10}, nodes, [3, 3, 3])


def test_growing_moves_a_bounded_part(spark):
    rows = spark.range(20000).selectExpr("id as doc_id")
    place = lambda n: {r.doc_id: r.shard for r in sharding.shard(rows, n, slack=0.25).collect()}
    a, b = place(24), place(25)
    assert sum(a[i] != b[i] for i in a) < 0.12 * len(a)


def brute_shards(spark, rows, shards):
    """Rows by shard when each point's rows go clockwise, point after point and round after round, to the next shard with room."""
    nodes = sharding.ring_nodes(spark, shards)
    room = dict(enumerate(sharding.load_bounds(len(rows), shards)))
    waiting = {p: n for p, n in sorted(Counter(r["_point"] for r in rows).items())}
    counts: Counter = Counter()
    tried: dict = defaultdict(list)
    while any(waiting.values()):
        for point in waiting:
            if not waiting[point]:
                continue
            clockwise = [s for p, s in nodes if p >= point] + [s for p, s in nodes if p < point]
            shard = next(s for s in clockwise if s not in tried[point])
            tried[point].append(shard)
            n = min(waiting[point], room[shard])
            counts[point, shard] += n
            room[shard] -= n
            waiting[point] -= n
    return {k: n for k, n in counts.items() if n}


def test_plan_against_brute_force_with_hot_keys(spark):
    """A key with a third of the rows, half of them alike in all columns, is spread over cells and shards."""
    data = [(i, f"text {i}") for i in range(3000)] + [(None, f"t{i}") for i in range(1500)] + [(None, "same")] * 1500
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("tags", F.create_map(F.lit("a"), F.col("text")))
    point = sharding._point(F.lit("key"), sharding.row_hash(docs.select("doc_id"))).alias("_point")
    out = sharding.shard(docs, 7)
    got = out.select("*", point).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(data)
    assert Counter((r["_point"], r.shard) for r in got) == brute_shards(spark, docs.select(point).collect(), 7)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    key = lambda frame: Counter((r.doc_id, r.text, r.shard, r.slot) for r in frame.collect())
    assert key(out) == key(sharding.shard(docs.repartition(11), 7))


def test_shards_of_a_long_text(spark):
    docs = corpus.frame(spark, [(1, "é" * 2_000_000, *[None] * 6), (2, None, *[None] * 6)])
    got = {r.doc_id: r for r in sharding.shard_report(docs).collect()}
    assert got[1]["size"] == 4_000_008 and got[2]["size"] == 8 and got[2].text_crc32 == 0
