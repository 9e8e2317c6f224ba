import random
import re

import duckdb

from revlens.llm import decontam

DOCS, ITEMS = "doc_id long, text string, item_id string, h long", "item_id long, text string, doc_id long"


def tables(seed=1):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(120)] + ["the", "of", "é"] * 20
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 50)))) for i in range(40)] + [(50, None), (51, ""), (52, " the "), (None, "a b c d e f g")]
    docs = []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        if i % 3 == 0:
            x = items[rng.randrange(40)][1].split()
            for _ in range(len(x) // 6):
                x[rng.randrange(len(x))] = "other"
            a = rng.randrange(len(w) + 1)
            w[a:a] = x
        docs.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(w), None, 1))
    docs += [(200, None, "", 0), (201, "", "", 0), (202, " ", "", 0), (202, items[3][1].upper(), "", 0), (None, items[3][1], "", 0), (203, "the of " * 20_000, "", 0), (204, "the the the the " * 4, "", 0)]
    return docs, items


def brute(docs, items, window=13, share=0.75):
    def words(t):
        return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = {}
    span = max(max(m) for m in decontam.MASKS)
    for d, t in docs:
        w = words(t)
        if d is None:
            continue
        place = {}
        for at in range(len(w)):
            for _, masks in decontam.BY_SIZE:
                for m in masks:
                    if at + max(m) < len(w) and at not in (had := place.setdefault((m, tuple(w[at + j] for j in m)), [])):
                        had.append(at)
        for i, s in items:
            v = words(s)
            if i is None or not v:
                continue
            masks = next(masks for least, masks in decontam.BY_SIZE if len(v) >= least)
            need = -(-int(share * 100) * min(window, len(v)) // 100)
            for p in range(len(v)):
                for m in masks:
                    if p + max(m) >= len(v):
                        continue
                    for at in place.get((m, tuple(v[p + j] for j in m)), ()):
                        e = [0 <= at + q < len(w) and 0 <= p + q < len(v) and w[at + q] == v[p + q] for q in range(span + 1 - window, window)]
                        best = max(sum(e[s : s + window]) for s in range(window - span))
                        if best >= need:
                            a, b, c = out.get((d, i), (0, 1 << 60, 0))
                            out[d, i] = max(a, best), min(b, at), c + 1
    return {(*k, *v) for k, v in out.items()}


def test_same_as_brute_force_and_sql(spark):
    docs, items = tables()
    d, i = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([(a, b, 1) for a, b in items], ITEMS)
    want = brute([(x[0], x[1]) for x in docs], items)
    assert len(want) > 30
    assert {tuple(r) for r in decontam.leaks(d, i).collect()} == want
    assert {tuple(r) for r in decontam.leaks(d, i, sent=0).collect()} == want
    con = duckdb.connect()
    con.execute("create table documents as select * from (values " + ",".join("(?::bigint, ?::varchar)" for _ in docs) + ") t(doc_id, text)", [x for r in docs if r[0] not in (None, 202, 203) for x in r[:2]] + [None] * 2 * sum(r[0] in (None, 202, 203) for r in docs))
    con.execute("create table benchmark as select * from (values " + ",".join("(?::bigint, ?::varchar)" for _ in items) + ") t(item_id, text) where item_id is not null", [x for r in items for x in r])
    assert set(con.sql(decontam.oracle()).fetchall()) == {x for x in want if x[0] not in (202, 203)}


def test_clean(spark):
    docs, items = tables()
    d, i = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([(a, b, 1) for a, b in items], ITEMS)
    bad = {r["doc_id"] for r in decontam.leaks(d, i).collect()}
    kept = decontam.clean(d, i)
    assert kept.schema == d.schema
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r[0]) for r in docs if r[0] not in bad)
    assert decontam.leaks(d.limit(0), i).collect() == decontam.leaks(d, i.limit(0)).collect() == []


def test_masks_find_all_tolerated_substitutions():
    """Every way to place as many substitutions as are tolerated leaves some mask whole."""
    from itertools import combinations

    for n in range(1, 14):
        masks = next(masks for least, masks in decontam.BY_SIZE if n >= least)
        for gone in combinations(range(n), n - -(-75 * n // 100)):
            assert any(all(a + j not in gone for j in m) for m in masks for a in range(n - max(m))), (n, gone)


def test_long_items_and_texts(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(50_000)}"
    item = [word() for _ in range(20_000)]
    text = [word() for _ in range(1_000_000)]
    text[700_000:700_020] = item[5_000:5_020]
    i = spark.createDataFrame([(1, " ".join(item)), (2, "the " * 8_000)], "item_id long, text string")
    d = spark.createDataFrame([(1, " ".join(text)), (2, "the the " * 10), (3, " ".join(item[100:109])), (4, " ".join(item[19_000:19_013]))], "doc_id long, text string").repartition(2)
    for sent in (64 << 20, 0):
        got = {(r["doc_id"], r["item_id"]): (r["matched"], r["doc_word"]) for r in decontam.leaks(d, i, sent=sent).collect()}
        assert got.keys() == {(1, 1), (2, 2), (4, 1)} and got[1, 1] == (13, 700_000) and got[4, 1] == (13, 0)


def test_short_items(spark):
    items = [(n, " ".join(f"w{n}_{k}" for k in range(n))) for n in range(1, 10)]
    docs = [(20, "w3_0 x w3_1 w3_2 w2_0"), (21, "w2_1 w2_0")]
    for n, t in items:
        x = t.split()
        for k in range(0, n - -(-75 * n // 100)):
            x[(2, 5)[k] if n > 5 else k + 1] = "other"
        docs.append((n, "so it goes " + " ".join(x) + " and on"))
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(n, n) for n in range(1, 10)}
