import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.llm import shallot

SCHEMA = "vec_id long, embedding array<double>"
CLASH = ["v", "near", "second", "upper", "lower", "cluster", "distance", "hash", "n", "s0"]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit("x").alias(c) for c in CLASH])


def twin(rows, k=16, rounds=3):
    """Lloyd's rounds by comparing all, in Python integers."""
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows
            if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(at)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    sums = {}
    for d, c in found:
        sums[c] = sums.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in at]
    return [(i, c, d, sums[c], sum(sums.values()), sha[c]) for (i, _), (d, c) in zip(kept, found)]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def check(spark, rows):
    assert order(shallot.clusters(spark, table(spark, rows)).collect()) == order(twin(rows))


def test_equals_comparing_all(spark):
    r = random.Random(1)
    middles = [[r.gauss(0, 0.4) for _ in range(64)] for _ in range(9)]
    check(spark, [(i, [x + r.gauss(0, 0.15) for x in r.choice(middles)]) for i in range(600)])


def test_ties_repeats_nulls_and_odd_vectors(spark):
    r = random.Random(2)
    grid = [(i, [float(r.randrange(-1, 2)) if j < 3 else 0.0 for j in range(64)]) for i in range(200)]
    odd = [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [None] + [1.0] * 63), (505, [math.nan] + [0.0] * 63),
           (506, [math.inf] + [0.0] * 63), (None, [0.5] * 64), (None, [0.5] * 64), (7, [0.25] * 64), (508, [-0.001] * 64), (509, [1000.5] * 64)]
    check(spark, grid + odd + grid[:50] + [(600, [0.125] * 64)] * 150)


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_vectors(spark, n):
    check(spark, [(i, [float(i)] * 64) for i in range(n)])


def test_all_equal(spark):
    check(spark, [(i, [0.3] * 64) for i in range(40)])


def test_large_components_raise(spark):
    with pytest.raises(Exception, match="too large in vector 3"):
        shallot.clusters(spark, table(spark, [(3, [1e12] * 64)])).collect()


def test_bounds_hold_and_spare_searches():
    """Over rounds of moving centroids the state equals a full comparison, and most vectors are not searched again."""
    r = np.random.default_rng(5)
    middles = r.integers(-300, 300, (12, 8))
    v = (middles[r.integers(0, 12, 4000)] + r.integers(-20, 21, (4000, 8))).astype(np.int64)
    at, before = v[r.choice(4000, 12, replace=False)].copy(), None
    near, second = np.zeros(4000, np.int64), np.ones(4000, np.int64)
    upper, lower = np.full(4000, shallot.FAR), np.zeros(4000, np.int64)
    searched, plain = [], shallot.search
    try:
        shallot.search = lambda x, *rest: searched.append(len(x)) or plain(x, *rest)
        for _ in range(8):
            near, second, upper, lower = shallot.step(v, near, second, upper, lower, shallot.Centres.of(at, before))
            d = ((v[:, None, :] - at[None]) ** 2).sum(2)
            assert (near == d.argmin(1)).all()
            own = d[np.arange(4000), near]
            d[np.arange(4000), near] = np.iinfo(np.int64).max
            assert (upper.astype(float) ** 2 >= own).all() and (np.maximum(lower, 0) ** 2 <= d.min(1)).all()
            before, at = at, np.array([v[near == j].sum(0) // max(1, (near == j).sum()) if (near == j).any() else at[j] for j in range(12)])
    finally:
        shallot.search = plain
    assert searched[0] > 3000 and sum(searched[4:]) < searched[0]


def test_the_ball_leaves_centroids_out():
    """Far centroids are not compared: their distances are never computed."""
    at = np.array([[0, 0], [10, 0], [5000, 0], [9000, 0]], np.int64)
    v = np.array([[1, 0], [9, 1]], np.int64)
    seen, plain = [], shallot._square
    try:
        shallot._square = lambda x, m: seen.append(np.atleast_2d(m)[:, 0].max()) or plain(x, m)
        best, other, d, d2 = shallot.search(v, np.array([1, 1]), np.array([0, 0]), shallot.Centres.of(at))
    finally:
        shallot._square = plain
    assert best.tolist() == [0, 1] and other.tolist() == [1, 0] and d.tolist() == [1, 2] and d2.tolist() == [81, 82]
    assert max(seen) == 10
