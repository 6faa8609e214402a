"""Line dedup and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cloakwork.llm import lines, neardup
from cloakwork.llm.graph import components

from . import corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_line_report(spark):
    data = corpus.rows()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t, *_ in data:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    largest = {k: max((i for i in s if i is not None), default=None) for k, s in holders.items() if len(s) >= 5}
    assert largest
    want = []
    for i, t, *_ in data:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if key(x) not in largest or largest[key(x)] == i]
        want.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = [tuple(r) for r in lines.line_report(corpus.frame(spark, data)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lines_of_nothing_and_columns(spark):
    assert lines.line_report(corpus.empty(spark)).count() == 0
    out = lines.dedup_lines(corpus.frame(spark))
    assert out.columns == [*corpus.frame(spark).columns, "n_lines", "n_dropped", "kept_text"]


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([" ".join(words)] if len(words) < width else (" ".join(words[i : i + width]) for i in range(len(words) - width + 1)))


def brute(data, width, percent):
    """(n_shingles, component id) for each row, rows with equal sets as one node."""
    sets = [shingles(t, width) for _, t, *_ in data]
    parent = list(range(len(data)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                    parent[top(i)] = top(j)
    smallest = {}
    for i, row in enumerate(data):
        if row[0] is not None:
            smallest[top(i)] = min(smallest.get(top(i), row[0]), row[0])
    return sorted(((row[0], len(sets[i]), smallest.get(top(i))) for i, row in enumerate(data)), key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    data = corpus.rows()
    got = neardup.near_duplicates(corpus.frame(spark, data), width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(data, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_group_of_near_copies_with_a_common_passage(spark):
    """Hundreds of variants of one text, and as many unrelated texts that share half of theirs."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    data = []
    for i in range(420):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        data.append((i, " ".join(words), *[None] * 6))
    for i in range(420, 620):
        data.append((i, " ".join(base[:25] + [f"y{rng.randrange(10**6)}" for _ in range(30)]), *[None] * 6))
    got = neardup.near_duplicates(corpus.frame(spark, data), 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(data, 3, 85)


def test_one_of_each_group_stays(spark):
    data = corpus.rows()
    kept = neardup.keep_one(corpus.frame(spark, data))
    assert kept.columns == corpus.frame(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    want = {c for i, _, c in brute(data, 5, 80) if i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert len(ids) == len(set(ids))


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_report(corpus.empty(spark)).count() == 0
    only = corpus.frame(spark, [(1, None, *[None] * 6), (2, "", *[None] * 6)])
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_report(only).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_overlap_floor_is_rarely_missed():
    floor = neardup.overlap_floor(48, 85)
    assert 15 < floor < 41
    assert neardup.overlap_floor(48, 100) == 48
    rng = np.random.default_rng(0)
    assert (rng.binomial(48, 0.85, 200_000) >= floor).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_with_many_salts_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lines, "SALT_ROWS", 3)
    monkeypatch.setattr(lines, "HOT_LINES", 2)
    test_line_report(spark)
    shared = [f"shared line number {n} that is long enough to be counted as one" for n in range(4)]
    data = [(i, "\n".join([*shared[: 1 + i % 4], f"own {i}"]), *[None] * 6) for i in range(40)]
    data.append((100, "\n".join(f"{shared[n % 4]}" if n % 1000 == 0 else f"line {n}" for n in range(200_000)), *[None] * 6))
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.line_report(corpus.frame(spark, data)).collect()}
    assert got[100] == (200_000, 0)  # the largest doc_id keeps them
    assert got[3] == (5, 4) and got[0] == (2, 1)


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(17)
    words = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    near = [w if i % 97 else "changed" for i, w in enumerate(words)]
    other = [f"v{rng.randrange(50_000)}" for _ in range(300_000)]
    data = [(3, " ".join(words), *[None] * 6), (1, " ".join(near), *[None] * 6), (2, " ".join(other), *[None] * 6), (4, " ".join(words[:100_000]), *[None] * 6)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(corpus.frame(spark, data), 3, 85).collect())
    assert got == [(i, len(shingles(t, 3)), {1: 1, 3: 1, 2: 2, 4: 4}[i]) for i, t, *_ in sorted(data)]


@pytest.mark.parametrize("members", [2, 256])
def test_hubs_in_parts(spark, monkeypatch, members):
    monkeypatch.setattr(neardup, "HUB_MEMBERS", members)
    test_group_of_near_copies_with_a_common_passage(spark)
