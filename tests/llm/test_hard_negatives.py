"""Hard negatives against sorting all scores; the tree's invariants."""

import math

import numpy as np
import pytest

from pricelens.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int, row bigint, slot int, n2 double"


def vectors(n=700, d=6, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = []
    for i in range(n):
        x = centres[rng.integers(6)] + rng.normal(size=d) * rng.choice([0.02, 0.3, 1.0])
        rows.append((i, [float(v) for v in x], int(rng.integers(0, 4))))
    rows += [rows[10], rows[10], rows[100], (100, rows[3][1], 2), (None, rows[3][1], 2), (None, rows[3][1], 1), (5000, None, 1), (5100, rows[4][1], None),
             (5200, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (5300, [float("nan")] * 6, 1), (5400, [float("inf")] + [0.0] * 5, 1), (5500, [], 3), (5600, [0.0] * 6, 3),
             (5700, [1.0, 2.0], 0), (-100, rows[7][1], 0), (5800, [1e308] * 6, 1)]
    rows += [(6000 + i, rows[20][1], i % 2) for i in range(40)]  # one vector, many rows
    return rows


def brute(rows, anchors=100, positives=5, negatives=10):
    part = []
    for i, (vec_id, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v):
            part.append((i, vec_id, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, vec_id, label, v in part:
        if vec_id is None or vec_id % anchors:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), k is None, k or 0, j, m) for j, k, m, w in part if j != i))
        pos = [x for x in scored if x[4] == label][:positives]
        for p in pos:
            neg = [x for x in scored if x[4] != label and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0]][:negatives]
            out += [(vec_id, None if p[1] else p[2], r + 1, None if x[1] else x[2], -p[0], -x[0]) for r, x in enumerate(neg)]
    return sorted(out, key=repr)


def mine(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], SCHEMA).repartition(3)
    got = H.hard_negatives(spark, df, anchor="vec_id % 100 = 0", **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("shard", [4096, 100])
def test_equals_brute_force(spark, shard):
    want = brute(vectors())
    assert len(want) > 300 and mine(spark, vectors(), shard=shard) == want


def test_blocks_of_anchors_and_small_trees(spark, monkeypatch):
    for name, v in (("BLOCK", 3), ("QUERIES", 2), ("LEAF", 4), ("FIRST", 1), ("FANOUT", 3)):
        monkeypatch.setattr(H, name, v)
    assert mine(spark, vectors(400, seed=8), shard=50) == brute(vectors(400, seed=8))


def test_large_components_are_exact(spark):
    rows = [(i, [x * 1e6 + i, -x * 3e5, 7.25 * i], i % 3) for i, x in enumerate(np.random.default_rng(1).normal(size=150).tolist())] * 2
    assert mine(spark, rows) == brute(rows)


def test_edges(spark):
    assert mine(spark, []) == []
    assert mine(spark, [(100, [1.0], 1)]) == [] and mine(spark, [(100, [1.0], 1), (1, [1.0], 1)]) == []
    assert mine(spark, [(None, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == []
    same = [(100, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 3.0], 2), (3, [-1.0, 0.0], 2)]  # a positive score of zero
    assert mine(spark, same) == brute(same) == [(100, 1, 1, 2, 0, 0)]


def test_tree_covers_nests_and_separates():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(500, 5))
    points[100:160] = points[100]
    tree = H.Tree(points, 4, 8)
    assert sorted(np.concatenate([m for _, _, m in tree.leaves]).tolist()) == list(range(500))
    below = {(level, i): set(m.tolist()) for level, i, m in tree.leaves}
    for level in range(len(tree.levels) - 1, -1, -1):
        centres, radii, parents = tree.levels[level]
        for i, parent in enumerate(parents):
            own = sorted(below[level, i])
            d = np.sqrt(((points[own] - centres[i]) ** 2).sum(1))
            assert d.max() <= radii[i] + 1e-12 and d.min() == 0  # covers, and the centre is one of its points
            if level:
                below.setdefault((level - 1, parent), set()).update(own)
    for level in range(1, len(tree.levels)):
        centres, _, parents = tree.levels[level]
        for parent in set(parents.tolist()):
            kids = centres[parents == parent]
            up = tree.levels[level - 1][0][parent]
            assert (kids == up).all(axis=1).any()  # nests
            assert len(np.unique(kids, axis=0)) == len(kids)  # separates


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(300, 4)) * 256)
    n2 = (v * v).sum(1)
    tree = H.Tree(H.augmented(v, n2, n2.max()), 4, 8)
    q = np.floor(rng.normal(size=(20, 4)) * 256)
    for level, i, members in tree.leaves:
        low, up = H.bounds(q, np.sqrt((q * q).sum(1)), tree.levels[level][0][[i]], tree.levels[level][1][[i]])
        s = q @ v[members].T
        assert (low <= s).all() and (s <= up).all()
