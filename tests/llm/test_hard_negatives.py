"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import hard_negatives

SCHEMA = "rank string, vec_id long, embedding array<double>, label int, scores int"


def brute(rows, anchor):
    best = {}
    for _, i, x, label, *_ in rows:
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            own = (label, tuple(x))
            best[i] = min(best.get(i, own), own)
    scaled = {i: (l, [int(v) * 256 if abs(v) >= 2**52 else math.floor(256 * v) for v in x]) for i, (l, x) in best.items()}
    out = []
    for a, (label, x) in scaled.items():
        if not anchor(a):
            continue
        score = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in scaled.items() if len(y) == len(x) and i != a}
        order = lambda i: (-score[i], i)
        for p in sorted((i for i in score if scaled[i][0] == label), key=order)[:5]:
            fit = [i for i in score if scaled[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(sorted(fit, key=order)[:5], 1)]
    return sorted(out)


def check(spark, rows, every=5, **sizes):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hard_negatives.mine(vectors, F.col("vec_id") % every == 0, **sizes)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, found.collect()))
    assert got == brute(rows, lambda i: i % every == 0)
    return got


def vectors(seed, n=400, dims=6, labels=4, spread=0.4):
    pick = np.random.default_rng(seed)
    centre = pick.standard_normal((labels, dims)) * spread
    label = pick.integers(0, labels, n)
    x = centre[label] + pick.standard_normal((n, dims)) * 0.5
    return [("r", i, v.tolist(), int(l), 1) for i, (v, l) in enumerate(zip(x, label))]


@pytest.mark.parametrize("seed, dims, labels, sizes", [(1, 6, 4, {}), (2, 32, 2, {"shard_rows": 100, "anchor_rows": 17}), (3, 1, 3, {"shard_rows": 64}), (4, 8, 300, {})])
def test_equals_all_pairs(spark, seed, dims, labels, sizes):
    assert check(spark, vectors(seed, dims=dims, labels=labels), page=16, **sizes)


def test_ties_and_copies(spark):
    """Vectors with few values, so that most scores tie, and one that a third of the rows have."""
    pick = np.random.default_rng(9)
    rows = [("r", i, [1.0, 0.5] if i % 3 == 0 else pick.integers(-1, 3, 2).astype(float).tolist(), i % 4, 1) for i in range(300)]
    assert check(spark, rows, shard_rows=50)


def test_odd_rows(spark):
    rows = vectors(5, n=60, dims=3)
    rows += [
        ("r", 100, None, 1, 1),
        ("r", 101, [1.0, None, 2.0], 1, 1),
        ("r", 102, [1.0, float("nan"), 2.0], 1, 1),
        ("r", 103, [1.0, float("-inf"), 2.0], 1, 1),
        ("r", 105, [1.0, 1.0, 2.0], None, 1),
        ("r", None, [1.0, 1.0, 2.0], 1, 1),
        ("r", 110, [1.0, 1.0], 1, 1),
        ("r", 115, [1.0, 1.5], 1, 1),
        ("r", 116, [1.0, 1.25], 2, 1),
        ("r", 120, [], 2, 1),
        ("r", 121, [], 2, 1),
        ("r", 122, [], 3, 1),
        ("r", 125, [0.0, 0.0, 0.0], 2, 1),
        rows[5],
        rows[5],
        ("r", 5, [9.0, 9.0, 9.0], 0, 1),
    ]
    check(spark, rows)
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(rows[:3], SCHEMA), F.lit(None).cast("boolean")).count() == 0


def test_large_components(spark):
    """Where doubles are no longer exact, whole numbers go on."""
    pick = np.random.default_rng(3)
    rows = [("r", i, [float(v) for v in pick.integers(-(10**6), 10**6, 3)] + [1.0], i % 3, 1) for i in range(90)]
    check(spark, rows)
    rows = [("r", i, [1e12 if i % 10 == 0 else 0.0, 2.0**-60, float(i % 7) / 3], i % 3, 1) for i in range(1, 90)] + [("r", 0, [0.0, 1.0, 0.5], 0, 1)]
    check(spark, rows, every=45)
    tree = hard_negatives.integers([np.array([1e300, -3.7e-3])])
    assert tree.tolist() == [[int(1e300) * 256, -1]]


def test_boxes_bound_scores():
    pick = np.random.default_rng(4)
    x, labels = pick.integers(-50, 50, (1000, 5)).astype(float), pick.integers(0, 3, 1000)
    tree = hard_negatives.RTree(x, labels, np.arange(1000), page=20, fanout=4)
    assert sorted(tree.keys.tolist()) == list(range(1000)) and len(tree.levels) > 2
    anchors = pick.integers(-50, 50, (7, 5)).astype(float)
    for low, high in tree.bounds(anchors)[-1:]:
        for p, (i, j) in enumerate(tree.pages):
            s = tree.points[i:j] @ anchors.T
            assert (s.min(0) >= low[:, p]).all() and (s.max(0) <= high[:, p]).all()


def test_queue_leaves_boxes_out():
    """In a few dimensions most pages stay closed, and the order of keys decides ties on the edge of a box."""
    pick = np.random.default_rng(6)
    x, labels = np.floor(pick.standard_normal((20_000, 2)) * 256), pick.integers(0, 4, 20_000)
    tree = hard_negatives.RTree(x, labels, np.arange(20_000))
    found = tree.search(x[0], [(a[0], b[0]) for a, b in tree.bounds(x[:1])], int(labels[0]), True, [(None, None)], 5, 0)[0]
    score = x @ x[0]
    expected = sorted((-int(score[i]), i) for i in np.flatnonzero(labels == labels[0]) if i)[:5]
    assert found == expected
    assert tree.scored < 4_000
