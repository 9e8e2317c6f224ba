import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from revlens.llm import lm

SCHEMA = "doc_id long, text string, word string, k int, score double"


def make(n=500):
    rng = random.Random(1)
    langs = [[f"{p}{i}" for i in range(200)] for p in ("Aé", "b", "c")]
    docs = []
    for i in range(n):
        v = rng.choice(langs)
        docs.append((i, " ".join(v[min(int(rng.expovariate(0.05)), 199)] for _ in range(rng.randrange(0, 60)))))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "unseen words only"), (3, "again"), (None, "b1 b2"), (n + 4, "b1 " * 20_000)]
    return docs


def base(docs):
    def toks(t):
        return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]

    c = collections.Counter()
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            c.update(toks(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        x = toks(t)
        out.append((-1 if i is None else i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(x), sum(w in c for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)))
    return sorted(out)


@pytest.mark.parametrize("sent", [300, 100_000])
def test_base_and_gain(spark, sent, monkeypatch):
    docs = make()
    d = spark.createDataFrame([(*r, "x", 1, 0.0) for r in docs], SCHEMA).repartition(3)
    got = sorted([((-1 if r["doc_id"] is None else r["doc_id"]), *tuple(r)[1:]) for r in lm.lm_scores(d, sent=sent).collect()], key=lambda r: r[:3])
    for g, w in zip(got, base(docs), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held) * 0.97  # less negative than the base by 3 % at least


def counts_of(d, most=10**6):
    table = lm.counted(d)
    cond = lm.most_frequent(table, "word", "c", most)
    top = [tuple(r) for r in table.where(cond).collect()]
    arrays = tuple(np.array([f(w, c) for w, c in top], t).view(np.int64) for f, t in ((lambda w, c: lm.word_hash(w.encode()), np.uint64), (lambda w, c: lm.xxhash.xxh64_intdigest(w.encode(), lm.SECOND), np.uint64), (lambda w, c: c, np.int64)))
    rest = [tuple(r) for r in table.where(~cond).collect()]
    tail = np.zeros((lm.WIDTH, 2))
    for w, c in rest:
        tail[lm.word_hash(w.encode()) % lm.WIDTH] += 1, c
    ends = d.where("train").count()
    return lm.Counts(sum(c for _, c in top + rest) + ends, len(top) + len(rest) + 1, ends, arrays, tail), dict(top + rest)


def arrays_of(counts):
    return counts.key


def test_probabilities_sum_to_one(spark):
    """Over all words, an unknown one for each place of the tail, and the end; whatever stands before."""
    d = lm.prepared(spark.createDataFrame([(*r, "x", 1, 0.0) for r in make(300)] + [(5000, " ".join(f"w{i % 1500}" for i in range(9000)), "", 1, 0.0)], SCHEMA), 10)
    for most in (10**6, 1200):
        counts, words = counts_of(d, most)
        assert len(words) > 1500 and counts.classes > lm.CLASSES + 1
        m = lm.trained(d, counts)
        distinct = [w.encode() for w in words]
        _, (cls, pos, c) = counts.found(distinct)
        assert all(a in (-1, words[w.decode()]) for w, a in zip(distinct, c.tolist())) and (c >= 0).sum() == len(arrays_of(counts))
        cells = [(a, b, words[w.decode()]) for w, a, b in zip(distinct, cls.tolist(), pos.tolist())] + [(*counts.end, counts.ends)] + [(counts.tail, p, 0) for p in range(lm.WIDTH)]
        assert len({x[:2] for x in cells if x[0] < lm.CLASSES}) == sum(x[0] < lm.CLASSES for x in cells)  # places of their own
        cls, pos, c = map(np.array, zip(*cells))
        share = np.where(cls < lm.CLASSES, 1, (c + 0.1) / counts.mass[cls, pos].clip(1e-9))
        for before in ((b"a", b"w7"), (b"w3", b"never seen"), None):
            w1, w2 = (np.full(len(cls), lm.START if before is None else np.uint64(lm.word_hash(b))) for b in (before or (0, 0)))
            assert (10 ** m.of_tokens(cls, pos, w1, w2) * share).sum() == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("sent", [1_200, 100_000])
def test_score_against_brute_force(spark, sent, monkeypatch):
    """The score of each text from the model's weights, a token at a time."""
    docs = [(*r, "x", 1, 0.0) for r in make(120)] + [(5000 + i, " ".join(f"w{(7 * i + k) % 2500}" for k in range(700)), "", 1, 0.0) for i in range(8)]
    d = spark.createDataFrame(docs, SCHEMA).repartition(2)
    held = {}
    real = lm.trained
    monkeypatch.setattr(lm, "trained", lambda docs, counts, *a, **k: held.setdefault("m", (counts, real(docs, counts, *a, **k)))[1])
    got = sorted((r["n_tokens"], r["score"]) for r in lm.lm_scores(d, sent=sent).collect())
    counts, m = held["m"]
    words = {r["word"]: r["c"] for r in lm.counted(lm.prepared(d, 10)).collect()}

    def softmax(bias, rows):
        x = bias.astype(float) + sum(r.astype(float) for r in rows)
        return x - np.log(np.exp(x - x.max()).sum()) - x.max()

    one = lambda x: np.array([x], np.uint64)
    want = []
    for _, t, *_ in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        total, a, b = 0.0, lm.START, lm.START
        for x in [*w, None]:
            h = np.uint64(lm.word_hash(x.encode())) if x is not None else None
            if x is None:
                (c, p), n = counts.end, counts.ends
            else:
                c, p, n = (int(v[0]) for v in counts.found([x.encode()])[1])
                n = words.get(x, 0) if n < 0 else n
                assert n == words.get(x, 0)
            total += softmax(m.class_bias, m.first[m.rows_1(one(a), one(b))[0]])[c] + softmax(m.biases[c], m.second[m.rows_2(np.array([c]), one(a), one(b))[0]])[p]
            if c >= lm.CLASSES:
                total += math.log((n + 0.1) / counts.mass[c, p])
            a, b = h, a
        want.append((len(w) + 1, total / math.log(10)))
    for g, x in zip(got, sorted(want), strict=True):
        assert g[0] == x[0] and g[1] == pytest.approx(x[1], rel=1e-4)


def test_rare_words_gain_from_their_context(spark):
    """Words beyond the first 1,024, each after its own word, in held-out texts."""
    rng = random.Random(4)
    docs = []
    for i in range(3_000):
        k = [rng.randrange(3_000) for _ in range(30)]
        docs.append((i, " ".join(f"a{x} b{x}" for x in k), "x", 1, 0.0))
    d = spark.createDataFrame(docs, SCHEMA).repartition(2)
    for sent in (2_000, 100_000):
        held = [r for r in lm.lm_scores(d, sent=sent, rounds=2).collect() if r["held_out"]]
        assert len(held) > 200 and sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_ties_leave_words(spark):
    table = spark.createDataFrame([(f"w{i}", 7) for i in range(1000)] + [("x", 900)], "word string, c long")
    assert 300 < table.where(lm.most_frequent(table, "word", "c", 400)).count() <= 420
    assert table.where(lm.most_frequent(table, "word", "c", 2000)).count() == 1001


def test_nothing_to_learn(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    d = spark.createDataFrame([(held, "a b", "", 0, 0.0)], SCHEMA)
    r = lm.lm_scores(d).collect()
    assert [tuple(x)[:5] for x in r] == [(held, True, 3, 0, 0)] and r[0]["base_score"] == pytest.approx(0) and math.isfinite(r[0]["score"])
    assert lm.lm_scores(d.limit(0)).collect() == []
