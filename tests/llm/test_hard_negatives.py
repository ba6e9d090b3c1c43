import math
import random

import numpy as np
import pytest

from lithogrid.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    sound = []
    for i, vector, label in rows:
        if i is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            sound.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    found = []
    for i, label, vector in sound:
        if i % 100 == 0:
            positives = sorted((-score(vector, v), j) for j, own, v in sound if own == label and j != i)[:5]
            for minus, j in positives:
                fit = sorted((-score(vector, v), k) for k, own, v in sound
                             if own != label and 30 * -minus <= 100 * score(vector, v) <= 90 * -minus)[:10]
                found += [(i, j, n + 1, k, -minus, -less) for n, (less, k) in enumerate(fit)]
    return sorted(found)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(count, rng, width=8):
    centres = rng.normal(size=(6, width))
    return [(i, [float(x) for x in np.float32(centres[i % 6] + 0.4 * rng.normal(size=width))], int(rng.integers(0, 4))) for i in range(count)]


@pytest.mark.parametrize("shard,block", [(2048, 4096), (3, 37)])
def test_lists_match_brute_force(spark, monkeypatch, shard, block):
    """Small shards and blocks make several waves, trees and passes."""
    monkeypatch.setattr(hn, "SHARD", shard)
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "WAVE", 2)
    rows = clustered(1500, np.random.default_rng(1))
    rows += [(2000 + i, rows[100][1], 1 + i % 2) for i in range(40)]  # ties
    rows += [(None, rows[0][1], 1), (3001, None, 1), (3002, rows[0][1], None), (3003, [1.0, None], 1), (3004, [1.0, float("nan")], 1),
             (3005, [float("inf")] * 8, 1), (3006, [], 2), (3100, [0.5] * 3, 2), (3200, [0.1] * 12, 3), (3300, [0.0] * 8, 9), (3401, [-1.0] * 8, 9)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS shard", "'y' AS at", "'z' AS rank").repartition(5)
    assert rows_of(hn.hard_negatives(frame)) == brute(rows)


def test_large_components(spark):
    """Products beyond 2^53 are whole numbers too; those beyond 64 bits take the nearest 64-bit number."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 1e5 for _ in range(4)], i % 3) for i in range(0, 300, 5)]
    assert rows_of(hn.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    huge = np.array([[3e30, 1.0], [-3e30, 1.0]])
    assert hn._scores(huge, huge[0], 1e70).tolist() == [2 ** 63 - 1, -2 ** 63]


def test_no_rows(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(100, [1.0], 1), (100, [1.0], 1)], SCHEMA)).count() == 0


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(3)
    points = np.floor(rng.normal(size=(60, 5)) * 100)
    points[7] = points[8]
    order, up, length = hn.spanning_tree(points)
    assert sorted(order) == list(range(60)) and up[0] == -1 and (up[1:] < np.arange(1, 60)).all()
    edges = sorted((float(np.linalg.norm(points[i] - points[j])), i, j) for i in range(60) for j in range(i))
    root, total = list(range(60)), 0.0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for d, i, j in edges:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert length[1:].sum() == pytest.approx(total)


def test_bounds_leave_rows_out():
    """With close anchors most candidates are settled by their bounds alone, and the lists stay whole."""
    rng = np.random.default_rng(4)
    anchors = np.floor(1000 + rng.normal(size=(50, 8)) * 3)
    rows = np.floor(rng.normal(size=(2000, 8)) * 300)
    ids, labels = np.arange(2000), np.ones(2000, np.int64)
    order, up, length = hn.spanning_tree(anchors)
    shard = hn.Shard(0, -1 - np.arange(50), np.zeros(50, np.int64), anchors[order], up, length, [[(500_000, 600_000)]] * 50)
    kept = [[hn.Best(10)] for _ in range(50)]
    made = hn.bounded_scores(shard, rows, ids, labels, kept, False)
    assert made < 0.5 * 50 * 2000
    for at in range(50):
        scores = (rows @ anchors[order][at]).astype(np.int64)
        fit = np.flatnonzero((scores >= 500_000) & (scores <= 600_000))
        want = sorted((-scores[i], i) for i in fit)[:10]
        assert kept[at][0].ids.tolist() == [i for _, i in want]
