"""United boxes against a plain fixpoint, in any order and number."""

from __future__ import annotations

import random
import time

from cloakwork.operators.unions import unite_boxes, united


def plain(boxes):
    """Two boxes that overlap become one, until none do."""
    boxes = list(boxes)
    while True:
        pair = next(((a, b) for i, a in enumerate(boxes) for b in boxes[i + 1 :] if a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]), None)
        if pair is None:
            return sorted(boxes)
        a, b = pair
        boxes.remove(a)
        boxes.remove(b)
        boxes.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))


def drawn(rng, n, side, size):
    return [(x, y, x + rng.randint(1, size), y + rng.randint(1, size)) for x, y in ((rng.randint(0, side), rng.randint(0, side)) for _ in range(n))]


def test_united_boxes_equal_the_fixpoint():
    rng = random.Random(4)
    for _ in range(400):
        boxes = drawn(rng, rng.randint(0, 40), rng.choice([10, 60, 200]), rng.choice([3, 12]))
        assert united(boxes) == plain(boxes)


def test_pages_of_boxes(spark):
    rng = random.Random(5)
    pages = {p: drawn(rng, rng.randint(1, 60), 150, 12) for p in range(20)}
    rows = [(p, *map(float, b), "z") for p, boxes in pages.items() for b in boxes] + [(3, None, 1.0, 2.0, 3.0, "z"), (4, 5.0, 5.0, 5.0, 9.0, "z"), (None, 0.0, 0.0, 1.0, 1.0, "z")]
    got = {}
    for r in unite_boxes(spark.createDataFrame(rows, "p int, x1 double, y1 double, x2 double, y2 double, _in0 string"), "p").collect():
        got.setdefault(r.p, []).append((r.x1, r.y1, r.x2, r.y2))
    assert {p: sorted(v) for p, v in got.items()} == {p: plain(b) for p, b in pages.items()} | {None: [(0.0, 0.0, 1.0, 1.0)]}
    assert unite_boxes(spark.createDataFrame([], "p int, x1 double, y1 double, x2 double, y2 double"), "p").count() == 0


def test_a_page_of_a_hundred_thousand_boxes(spark):
    rng = random.Random(6)
    sparse = drawn(rng, 100_000, 30_000, 8)
    chain = [(i * 3, i % 7 * 5, i * 3 + 4, i % 7 * 5 + 60) for i in range(100_000)]  # one island, one box
    began = time.time()
    rows = spark.createDataFrame([(p, *map(float, b)) for p, boxes in ((1, sparse), (2, chain)) for b in boxes], "p int, x1 double, y1 double, x2 double, y2 double")
    made = unite_boxes(rows, "p").collect()
    assert [r.p for r in made].count(2) == 1
    found = [(r.x1, r.y1, r.x2, r.y2) for r in made if r.p == 1]
    assert 80_000 < len(found) < 100_000 and united(found) == sorted(found)
    assert time.time() - began < 300
