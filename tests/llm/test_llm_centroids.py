"""Operator 12 against plain integer clustering."""
import hashlib
import math
import random

import numpy as np
import pytest

from ecotally.llm import centroids


def brute(rows, n=16, rounds=3):
    """rows: (vec_id, components); (vec_id, cluster, distance) sorted, and the centroids."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    c = [list(v) for _, v in order[:n]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(c))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for k in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at) if a == k]
            if mine:
                c[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), c


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(4)


def vectors(seed, n=300, scale=1.0):
    rnd = random.Random(seed)
    mids = [[rnd.gauss(0, scale) for _ in range(64)] for _ in range(5)]
    return [(i, [x + rnd.gauss(0, scale / 20) for x in mids[rnd.randrange(5)]]) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e7])
def test_equals_plain_clustering(spark, scale):
    """Also with components whose sums of squares need more than 53 and 63 bits on the way."""
    rows = vectors(2, 120, scale)
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(1000, rows[0][1])]  # copies, a repeated row
    got, c = centroids.clustered(table(spark, rows))
    want, d = brute(rows)
    assert c == d and sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_unusable_vectors_and_few(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [0.5] * 63), (4, [0.5] * 63 + [None]), (5, [nan] + [0.0] * 63), (6, [inf] + [0.0] * 63), (7, [0.5] * 65)]
    good = [(8, [-0.001] * 64), (None, [0.7] * 64), (9, [0.0] * 64)]
    got, c = centroids.clustered(table(spark, bad + good))
    want, d = brute(good)
    assert c == d and sorted((tuple(r) for r in got.collect()), key=repr) == want and len(want) == 3
    none, c = centroids.clustered(table(spark, bad))
    assert c == [] and none.count() == 0
    assert centroids.clustered(table(spark, bad).limit(0))[0].count() == 0


def test_transform_is_exact_and_keeps_distances():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**20), 2**20, (50, 64))
    t = centroids.transform(x)
    assert [centroids.restored(r) for r in t.tolist()] == x.tolist()
    assert (((t[:1] - t) ** 2).sum(1) == 64 * ((x[:1] - x) ** 2).sum(1)).all()
    assert [int((np.diff(r) != 0).sum()) for r in centroids.H] == list(range(64))


def test_search_eliminates_and_breaks_ties_low():
    rng = np.random.default_rng(5)
    c = rng.integers(-500, 500, (16, 64))
    c[9] = c[4]
    x = c[rng.integers(0, 16, 400)] + rng.integers(-3, 3, (400, 64))
    at, d, work = centroids.nearest(centroids.transform(x), centroids.transform(c))
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert at.tolist() == full.argmin(1).tolist() and d.tolist() == full.min(1).tolist()
    assert 9 not in at.tolist() and work < 0.5 * x.size * 16
