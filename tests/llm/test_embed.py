import math

import numpy as np
import pytest

from revlens.llm import embed

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, cid int"


def vectors(n=400, d=32, seed=1):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=d) for _ in range(n)]
    base = rng.normal(size=d)
    out += [base + rng.normal(size=d) * 0.08 for _ in range(120)]
    for k in range(40):
        out.append(out[k] * 3 if k % 2 else out[k] + rng.normal(size=d) * 0.15)
    out += [out[5]] * 6
    rows = [(i, [float(np.float32(v)) for v in x], i % 3, "x", 1) for i, x in enumerate(out)]
    odd = [None, [], [0.0] * d, [1.0, None] + [1.0] * (d - 2), [float("nan")] * d, [math.inf] + [0.0] * (d - 1), rows[0][1][:8], rows[0][1][:8], [1e30] * d, [1e-30] * d]
    rows += [(10_000 + i, x, None, None, None) for i, x in enumerate(odd)]
    return rows


def brute(rows):
    ok = {i: np.array(v, float) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: set() for i, *_ in rows}
    ids = list(ok)
    unit = {i: ok[i] / np.abs(ok[i]).max() for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = unit[a], unit[b]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in comp:
                    comp[j] = i
                    todo += links[j]
    return links, comp


def test_exact(spark):
    rows = vectors()
    links, comp = brute(rows)
    for bucket in (4000, 200):
        got = embed.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), bucket=bucket, exact=True).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (len(v), comp[i]) for i, v in links.items()}


@pytest.mark.parametrize("bucket", [4000, 24])
def test_recall_and_exactness(spark, bucket):
    rows = vectors()
    links, comp = brute(rows)
    got = {r["vec_id"]: r for r in embed.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), bucket=bucket).collect()}
    assert set(got) == set(links)
    assert all(got[i]["n_links"] <= len(v) for i, v in links.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(map(len, links.values()))
    assert np.mean([got[i]["component_id"] == c for i, c in comp.items()]) > 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    d = spark.createDataFrame([(None, v, 0, "", 0), (4, v, 0, "", 0), (4, v, 0, "", 0), (9, [2.0, 4.0, 6.0], 0, "", 0), (2, None, 0, "", 0)], SCHEMA)
    got = sorted((tuple(r) for r in embed.near_duplicates(d).collect()), key=str)
    assert got == sorted([(None, 0, None, None), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (2, 0, 2, True)], key=str)
    assert embed.near_duplicates(d.limit(0)).collect() == []


@pytest.mark.parametrize("d", [64, 384])
def test_recall_of_many_rows_near_the_threshold(spark, d):
    rng = np.random.default_rng(9)
    n = 6_000
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, d))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.9001, 0.92, size=(n, 1))
    rows = [(i, v, 0, "", 0) for i, v in enumerate(np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * y]).tolist())]
    got = {r["vec_id"]: r for r in embed.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert len(got) == 2 * n and all(r["n_links"] <= 1 for r in got.values())
    found = [got[n + i]["n_links"] == 1 and got[n + i]["component_id"] == i for i in range(n)]
    print("recall", np.mean(found))
    assert np.mean(found) >= 0.97


def test_recall_at_the_substrings_of_large_tables():
    """The tables that 100 million rows would get, on pairs at cosine 0.90 to 0.92."""
    rng = np.random.default_rng(5)
    n, d = 3_000, 64
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, d))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.9001, 0.92, size=(n, 1))
    y = cos * x + np.sqrt(1 - cos * cos) * y
    parts = embed.cuts(100_000_000, 64)
    met = np.zeros(n, bool)
    for r in range(embed.rotations(parts, 0.9)):
        q = embed.Quantiser(x, seed=7 + r)
        differ = q.code(x) ^ q.code(y)
        near = np.bitwise_count(differ) <= embed.reach(64, 0.9)
        for a, k in parts:
            met |= near & ((differ >> np.uint64(a)) & np.uint64((1 << k) - 1) == 0)
    assert met.mean() >= 0.97
