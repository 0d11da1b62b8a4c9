"""Hard negatives against every pair."""

import math
import random

import pytest

from talus.llm.hardneg import mine

SHAPE = "vec_id long, label long, embedding array<double>, score string, block string"


def brute(rows, every=100, positives=5, negatives=10, scale=256):
    good = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * scale) for x in v):
            continue
        good.append((i, label, [math.floor(scale * x) for x in v]))
    top = (1 << 63) - 1
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -top), top)
    anchors = {}
    for i, label, v in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for i, (label, v) in anchors.items():
        same = sorted((-dot(v, x), j) for j, y, x in good if y == label and j != i)[:positives]
        others = sorted((-dot(v, x), j) for j, y, x in good if y != label)
        for s, p in same:
            fits = [(n, -t) for t, n in others if 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, p, k + 1, n, -s, t) for k, (n, t) in enumerate(fits)]
    return sorted(out)


def same(spark, rows, **how):
    df = mine(spark.createDataFrame(rows, SHAPE), **how)
    assert sorted(map(tuple, df.collect())) == brute(rows, every=how.get("every", 100))


@pytest.mark.parametrize("block,pack,held", [(1000, 128, 20_000), (7, 3, 4)])
def test_random_vectors_with_ties(spark, block, pack, held):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), [rng.randrange(-9, 10) / 16 for _ in range(5)], "x", None) for i in range(400)]
    rows += [(1000 + i, i % 3, rows[0][2], "x", None) for i in range(40)]  # a group of copies
    same(spark, rows, every=20, block=block, pack=pack, held=held)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5], "x", None), (0, 1, [1.0, 0.5], "x", None), (0, 2, [0.25, 0.5], None, "y"), (100, 1, [], None, None), (200, None, [1.0], "x", "x"),
        (300, 2, None, None, None), (400, 2, [1.0, None], None, None), (500, 1, [nan, 1.0], None, None), (600, 1, [inf], None, None), (None, 1, [1.0, 1.0], "x", None),
        (1, 1, [0.9], "x", None), (2, 1, [1.0, 0.5, 0.25], "x", None), (3, 2, [0.5, 0.5], "x", None), (4, 3, [0.5, 0.5], "x", None), (-100, 3, [-1.0, -0.5], None, None),
        (5, 3, [-0.5, 0.1], "x", None), (6, 1, [-0.5, -0.4], "x", None), (700, 9, [0.3, 0.3], "x", None), (7, 1, [1e308, 1.0], None, None),
    ]
    same(spark, rows)


def test_scores_beyond_a_double_and_a_long(spark):
    rng = random.Random(1)
    for size in (1e5, 3e13, 1e30):
        rows = [(i, i % 3, [size * rng.random() for _ in range(3)], None, None) for i in range(30)]
        same(spark, rows, every=10)


def test_nothing_to_do(spark):
    same(spark, [])
    same(spark, [(1, 1, [1.0], None, None)])
    same(spark, [(100, 1, [1.0], None, None)])
    same(spark, [(100, 1, [], None, None), (1, 1, [], None, None), (2, 2, [], None, None)])
