"""Hard negatives against every anchor with every row, on clustered, tied, repeated and faulty rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelrow.llm import hard_negatives as mining

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=5):
    """All pairs; rows as (id, vector, label)."""
    known = {}
    for id_, vector, label in rows:
        if id_ is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        scaled = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        if any(abs(x) >= mining.LIMIT for x in scaled):
            continue
        known[id_, label, scaled] = None
    known = list(known)
    out = []
    for anchor in known:
        if anchor[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(anchor[2], r[2])), r[0], r[1]) for r in known if r is not anchor]
        positives = sorted(x for x in scored if x[2] == anchor[1])[:5]
        for p in positives:
            inside = sorted(n for n in scored if n[2] != anchor[1] and 50 * -p[0] <= 100 * -n[0] <= 95 * -p[0])[:3]
            out += [(anchor[0], p[1], rank, n[1], -p[0], -n[0]) for rank, n in enumerate(inside, start=1)]
    return sorted(out)


def clustered(n, dims=6, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(7, dims))
    # a coarse grid, so that scores tie
    vectors = np.round((centres[draw.integers(0, 7, n)] + 0.4 * draw.normal(size=(n, dims))) * 8) / 8
    labels = draw.choice([0, 1, 2, 3], n, p=[0.6, 0.2, 0.1, 0.1])
    return [(i, [float(x) for x in v], int(label)) for i, (v, label) in enumerate(zip(vectors, labels))]


HARD = [
    (1000, None, 1), (1005, [], 0), (1010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1015, [float("nan")] * 6, 1),
    (1020, [float("inf")] * 6, 1), (1025, [0.5] * 6, None), (None, [0.5] * 6, 1), (1030, [1.0, 1.0], 1), (1035, [1e30] * 6, 1),
    (1040, [2.0] * 9, 2), (1041, [0.0] * 6, 2), (-5, [0.25] * 6, 0), (1050, [-1.0] * 6, 3), (1055, [0.5] * 6, 9),
]


def mined(spark, rows, every=5):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, mining.mine(df, F.col("id") % every == 0).collect()))


def test_equals_all_pairs_in_small_pieces_and_blocks(spark, monkeypatch):
    rows = clustered(400) + HARD
    # a group of equal vectors under many ids, and repeated rows
    rows += [(2000 + i, rows[3][1], i % 2) for i in range(60)] + rows[:20]
    expected = brute(rows)
    assert len({r[0] for r in expected}) > 50
    monkeypatch.setattr(mining, "PIECE", 50)
    monkeypatch.setattr(mining, "LEAF", 6)
    monkeypatch.setattr(mining, "FANOUT", 3)
    monkeypatch.setattr(mining, "ANCHORS", 40)
    assert mined(spark, rows) == expected


def test_equals_all_pairs_in_one_piece(spark):
    rows = clustered(700, dims=16, seed=4)
    assert mined(spark, rows, 7) == brute(rows, 7)


def test_result_does_not_hang_on_other_columns(spark):
    rows = [(*r, 1, 2, 3.5) for r in clustered(60)]
    df = spark.createDataFrame(rows, SCHEMA + ", id int, score int, `a b` double")
    assert sorted(map(tuple, mining.mine(df, F.col("id") % 5 == 0).collect())) == brute([r[:3] for r in rows])


def test_empty_and_without_pairs(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    # an anchor alone of its label, and one whose positives leave an empty window
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 2), (10, [1.0], 2)]) == []


def test_intervals_hold_every_product():
    draw = np.random.default_rng(3)
    vectors = draw.integers(-50, 50, (500, 5)).astype(float)
    order = mining.str_order(vectors, 16, 3)
    assert sorted(order.tolist()) == list(range(500))
    tree = mining.Tree(np.arange(500), np.zeros(500, np.int64), vectors[order])
    anchors = draw.integers(-50, 50, (20, 5)).astype(float)
    highest, lowest = tree.intervals(anchors)
    scores = anchors @ tree.vectors.T
    for node, (first, last) in enumerate(tree.children[0]):
        assert (scores[:, first:last] <= highest[0][:, [node]]).all() and (scores[:, first:last] >= lowest[0][:, [node]]).all()
    assert (scores.max(axis=1) <= highest[-1][:, 0]).all()


def test_search_leaves_boxes_out(monkeypatch):
    """On clusters far apart most leaves are never read."""
    draw = np.random.default_rng(6)
    vectors = np.round(draw.choice([-4000, 4000], (4096, 3)) + draw.normal(0, 30, (4096, 3)))
    order = mining.str_order(vectors, 64, 3)
    tree = mining.Tree(order, np.zeros(4096, np.int64), vectors[order])
    read, plain = [], mining.products
    monkeypatch.setattr(mining, "LEAF", 64)
    monkeypatch.setattr(mining, "products", lambda a, b: read.append(len(a)) or plain(a, b))
    tree = mining.Tree(order, np.zeros(4096, np.int64), vectors[order])
    anchors = mining.Anchors(np.array([0]), np.array([0]), vectors[:1])
    found = [[]]
    mining.search_positives(tree, anchors, found)
    scores = vectors @ vectors[0]
    assert found[0] == sorted((-int(s), i) for i, s in enumerate(scores) if i)[:5]
    # four products for the intervals of each level, then one a leaf
    assert len(read) - 4 * len(tree.children) <= 16


def test_large_components_are_exact(spark):
    rows = [(0, [5e5, 1.0], 1), (1, [5e5, 2.0], 1), (2, [3e5, 1.0], 2), (3, [3e5, 3.0], 2), (4, [6e5, 1.0], 2)]
    assert mined(spark, rows, 50) == brute(rows, 50) != []


@pytest.mark.parametrize("score", [-3, -1, 0, 1, 2, 7, 100, 101])
def test_windows(score):
    low, high = mining.windows(score)
    inside = {n for n in range(-200, 200) if 50 * score <= 100 * n <= 95 * score}
    assert set(range(low, high + 1)) == inside
