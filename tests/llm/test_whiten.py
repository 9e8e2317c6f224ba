import numpy as np
import pytest

from revlens.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, d int, y string"


def brute(rows, most=32):
    """Per vec_id: n, deviation and the whitened values' absolute numbers, by numpy over each length's list."""
    fit = {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) and abs(c) < 2**21 for c in v):
            fit.setdefault(len(v), []).append((i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]))
    out = []
    for d, own in fit.items():
        x = np.array([v for _, v in own], object)
        n, s = len(own), x.sum(0)
        y = ((n * x - s) / n).astype(float)
        e, w = np.linalg.eigh(y.T @ y / n)
        total, e, w = e.sum(), e[::-1][:most], w[:, ::-1][:, :most]
        real = e > d * 2.3e-16 * max(e[0], 0)
        for k, (i, _) in enumerate(own):
            z = [abs(float(y[k] @ w[:, c])) / np.sqrt(e[c]) if real[c] else None for c in range(len(e))]
            out.append((i, n, sum(int(c) ** 2 for c in n * x[k] - s), z, [float(c / total) if real.any() else None for c in np.where(real, e, 0)]))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0, 0, "") for i, v in rows], SCHEMA)
    by = {}
    for r in whiten.whitened(df, **kw).collect():
        by.setdefault((r["vec_id"], r["n"], r["deviation"]), []).append((r["component"], r["whitened"], r["explained"], r["identity_error"]))
    return {k: sorted(v) for k, v in by.items()}


@pytest.mark.parametrize("d, n", [(5, 60), (70, 150)])
def test_against_numpy(spark, d, n):
    g = np.random.default_rng(d)
    rows = [(i, g.normal(size=d).tolist()) for i in range(n)]
    got = run(spark, rows)
    want = brute(rows)
    assert len(got) == n
    full = min(d, 32)
    for i, count, deviation, z, _ in want:
        own = got[i, count, deviation]
        assert [c for c, *_ in own] == list(range(1, full + 1))
        assert [abs(v[1]) for v in own] == pytest.approx(z, rel=1e-6, abs=1e-8)
        assert max(v[3] for v in own) < 1e-4
    x = np.array([[np.floor(64 * np.float32(c)) for c in v] for _, v in rows])
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert [v[2] for v in got[next(iter(got))]] == pytest.approx((e / e.sum())[:full], rel=1e-6)


def test_same_signs_in_all_rows(spark):
    g = np.random.default_rng(1)
    rows = [(i, g.normal(size=4).tolist()) for i in range(50)]
    z = np.array([[v[1] for v in own] for own in run(spark, rows).values()])
    assert np.abs(z.T @ z / 50 - np.eye(4)).max() < 1e-9


def test_odd_rows(spark):
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0]]
    good = [(None, [0.1, 0.2, 0.3]), (7, [0.5, 0.2, 0.9]), (7, [0.5, 0.2, 0.9]), (8, [-0.4, 0.2, 0.1]), (9, [0.3]), (10, [0.9])]
    df = spark.createDataFrame([(k, v, 0, 0, "") for k, v in enumerate(bad)] + [(i, v, 0, 0, "") for i, v in good], SCHEMA)
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["component"], r["n"], r["whitened"]) for r in whiten.whitened(df).collect()), key=lambda t: t[:3])
    assert [g[:4] for g in got] == [(False, 7, 1, 4), (False, 7, 1, 4), (False, 7, 2, 4), (False, 7, 2, 4), (False, 7, 3, 4), (False, 7, 3, 4), (False, 8, 1, 4), (False, 8, 2, 4), (False, 8, 3, 4), (False, 9, 1, 2), (False, 10, 1, 2), (True, 0, 1, 4), (True, 0, 2, 4), (True, 0, 3, 4)]
    # the second dimension is constant and three distinct vectors span a plane: two components have variance, the third has no value
    assert all((g[4] is None) == (g[2] == 3) for g in got)


def test_constant_and_empty(spark):
    got = run(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])
    assert all(v[1:] == (None, None, None) for own in got.values() for v in own) and set(got) == {(1, 2, 0), (2, 2, 0)}
    assert run(spark, []) == {} and run(spark, [(1, None)]) == {}


def test_deviation_beyond_a_long():
    assert whiten.squares(np.array([[1 << 40, 3], [5, 12]])) == [None, 169]
