import random
import zlib

import pytest

from revlens.llm import shard

SCHEMA = "doc_id long, text string, shard string, size int, h long"


def run(spark, rows, shards=8, **kw):
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], SCHEMA)
    got = shard.sharded(df, shards, **kw).collect()
    text = lambda t: (t or "").encode()
    size = {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        size.setdefault(r["shard"], []).append(r)
    for own in size.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == sorted(((i, len(text(t)) + 1, zlib.crc32(text(t))) for i, t in rows), key=key)
    return got, [sum(r["size"] for r in size.get(k, [])) for k in range(shards)]


def smallest(sizes, shards):
    """The smallest capacity with which greedy filling fits, by trying one after another."""
    c = max(sizes)
    while True:
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        if used <= shards:
            return c
        c += 1


@pytest.mark.parametrize("seed", range(4))
def test_minimax(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(shard, "ABREAST", rng.choice([1, 2, 63]))
    texts = ["w" * rng.randrange(1, 40) + str(k) for k in range(80)]
    rows = [(i, rng.choice(texts)) for i in range(rng.choice([60, 300]))]
    shards = rng.choice([2, 3, 8])
    got, sizes = run(spark, rows, shards, block=rng.choice([5, 1000]))
    by = {r["doc_id"]: r["shard"] for r in got}
    home = {}
    for i, t in rows:
        assert home.setdefault(t, by[i]) == by[i]
    groups = spark.createDataFrame([(t,) for _, t in rows], "text string").select(shard.hashed("text").alias("h"), "text").collect()
    total = {}
    for r in groups:
        total[r["h"]] = total.get(r["h"], 0) + len(r["text"].encode()) + 1
    assert max(total.values()) * shards <= sum(total.values())  # none is a giant
    assert max(sizes) == smallest([total[h] for h in sorted(total)], shards)


def test_a_group_of_a_third(spark):
    rows = [(i, "hot text") for i in range(300)] + [(1000 + i, f"text {i:04d}x") for i in range(500)]
    got, sizes = run(spark, rows, 8, block=10)
    assert sizes[0] == 300 * 9 and len({r["shard"] for r in got if r["doc_id"] < 300}) == 1
    assert max(sizes[1:]) - min(sizes[1:]) <= 2 * 11


def test_even_within_the_capacity(spark):
    """Nine equal groups in eight shards: one shard has two, none is empty."""
    _, sizes = run(spark, [(i, f"group{i}") for i in range(9)])
    assert sorted(sizes) == [7] * 7 + [14]


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (None, None), (3, ""), (4, ""), (None, "x"), (None, "x"), (5, "x"), (5, "x"), (6, "é漢😀"), (7, "long " * 60_000)]
    got, _ = run(spark, rows)
    at = {}
    for r in got:
        at.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert len(at[2, zlib.crc32(b"x")]) == 1
    assert run(spark, [])[0] == [] and len(run(spark, [(1, "only")])[0]) == 1
    assert run(spark, [(1, "a"), (2, "b")], 1)[1] == [4]


def test_copies_of_one_row(spark):
    """Rows alike in doc_id and text are numbered in blocks."""
    got, _ = run(spark, [(1, "same")] * 200 + [(k, f"t{k}") for k in range(50)], 3, block=10)
    assert sum(r["doc_id"] == 1 and r["size"] == 5 for r in got) == 200


def test_same_as_sql(spark):
    """Also where groups fill shards of their own, texts are null or empty, and nothing is left for the last shards."""
    import duckdb

    rng = random.Random(9)
    for case in range(4):
        rows = [(i, rng.choice([None, "", "hot " * 9, "a", "é", *(f"t{k} " * rng.randrange(1, 9) for k in range(20))])) for i in range(rng.choice([3, 40, 200]))]
        rows += [(1000 + i, "giant " * 20) for i in range(30 * case)]
        con = duckdb.connect()
        con.execute("create table documents(doc_id bigint, text varchar)")
        con.executemany("insert into documents values (?, ?)", rows)
        want = {(a, b, c, e, f) for a, b, c, _, e, f, _ in con.sql(shard.oracle()).fetchall()}
        got, _ = run(spark, rows)
        assert {(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got} == want and len(want) == len(rows)
