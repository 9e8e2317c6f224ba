import hashlib

import numpy as np
import pytest

from revlens.llm import sortmeans

SCHEMA = "vec_id long, embedding array<float>, cluster string, x int"


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, tuple(int(np.floor(64 * float(np.float32(c)))) for c in v)) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) and abs(c) < 2**21 for c in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    cents = [list(x) for _, x in first] or [[0] * dims]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(near(x)[1], []).append(x)
        for c, xs in own.items():
            cents[c] = [sum(col) // len(xs) for col in zip(*xs)]
    got = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = {}
    for _, c, d in got:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((i if i is not None else -1, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in got)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "", 0) for i, v in rows], SCHEMA)
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, sortmeans.clustered(df, **kw).collect()))


@pytest.mark.parametrize("spread", [0.02, 0.2, 2.0])
def test_against_brute(spark, spread):
    """Tight groups stop scans early; small whole numbers tie often."""
    g = np.random.default_rng(int(spread * 100))
    mid = g.normal(size=(6, 4)) * 0.3
    rows = [(i, (mid[i % 6] + g.normal(size=4) * spread).tolist()) for i in range(300)]
    assert run(spark, rows, k=16, dims=4) == brute(rows, 16, 3, 4)


def test_ties_go_to_the_smaller_number():
    """A centroid exactly twice as far from the last one as the vector is must be met: it may be as near."""
    cents = np.array([[4, 0], [0, 0], [100, 100]])
    best, distance = sortmeans.nearest(np.array([[2, 0]]), np.array([1]), cents)
    assert (best.tolist(), distance.tolist()) == ([0], [4])


def test_scan_equals_full_search():
    g = np.random.default_rng(4)
    for _ in range(40):
        x, c = g.integers(-5, 6, (200, 3)), g.integers(-5, 6, (g.integers(1, 20), 3))
        best, distance = sortmeans.nearest(x, g.integers(0, len(c), 200), c)
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (best == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_odd_rows(spark):
    bad = [(90, None), (91, []), (92, [1.0]), (93, [1.0, None]), (94, [float("nan"), 1.0]), (95, [float("-inf"), 1.0]), (96, [1e20, 1.0])]
    rows = bad + [(None, [0.1, 0.2]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.25, -0.5]), (2, [0.5, 0.5]), (3, [-1.0, 3.0])]
    assert run(spark, rows, k=4, dims=2) == brute(rows, 4, 3, 2)
    assert run(spark, rows, k=16, dims=2) == brute(rows, 16, 3, 2)  # fewer rows than centroids
    assert run(spark, [(None, [0.1, 0.2])], k=2, dims=2) == brute([(None, [0.1, 0.2])], 2, 3, 2)
    assert run(spark, [], dims=2) == [] and run(spark, bad, dims=2) == []


def test_too_wide(spark):
    with pytest.raises(ValueError):
        sortmeans.clustered(spark.createDataFrame([], SCHEMA), dims=200)
