import random
import zlib

import numpy as np
import pytest

from revlens.llm import toxicity as tox

LEX = ["idiot", "moron", "stupid", "worthless", "pathetic"]


def make(n=900, seed=1):
    rng = random.Random(seed)
    syl = ["an", "the", "re", "ti", "on", "sh", "wh", "ou", "ed", "ing", "ble", "st"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syl) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(LEX))
        docs.append((i, " ".join(words), "x", 0.5))
        labels.append((i, 1, int(bad)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, score string, held_out double", "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = make()
    extra = [(10_000, None, None, None), (10_001, "", None, None), (None, "the on idiot", None, None), (5, docs[5][1], None, None), (10_002, "you 1d10t and m0r0n you stuuupid", None, None), (10_003, "an i d i o t is s.t.u.p.i.d", None, None), (10_004, "the on an 1234 10.20.30.40 ed", None, None), (10_005, "x1" * 20_000, None, None), (10_006, "an re " + " ".join("theon" * 30 + "stupidmoron"), None, None)]
    d = spark.createDataFrame(docs + extra, DOCS).repartition(3)
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (77_777, 1, 1)], LABELS)
    return d, lab, tox.learn(d, lab), dict((i, t) for i, _, t in labels)


def test_held_out_accuracy(learnt):
    d, _, scorer, truth = learnt
    rows = tox.scored(d, scorer).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.98
    by = {r["doc_id"]: r for r in rows}
    assert by[10_000]["predicted"] == by[10_001]["predicted"] == by[10_004]["predicted"] == by[10_005]["predicted"] == 0
    assert by[10_006]["predicted"] == by[10_002]["predicted"] == by[10_003]["predicted"] == by[None]["predicted"] == 1
    assert sum(r["doc_id"] == 5 for r in rows) == 2


def test_labels_of_held_out_rows_dont_count(spark, learnt):
    d, lab, scorer, _ = learnt
    from pyspark.sql import functions as F

    turned = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = tox.learn(d, turned)
    assert other.weights == scorer.weights and other.a == pytest.approx(scorer.a) and other.b == pytest.approx(scorer.b)


def test_disguises(learnt):
    model = learnt[2].model
    for seen, true in (("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuupid", "stupid"), ("p@thet1c", "pathetic"), ("s.t.u.p.i.d", "stupid"), ("w-o-r-t-h-l-e-s-s", "worthless")):
        assert true in model.readings(seen), (seen, model.readings(seen))
    assert "worthless idiot" in model.decode(" ".join("worthlessidiot"), spaced=True)
    long = model.decode(" ".join("pathetic" * 300), spaced=True)[0].split()  # no bound on the length
    assert long.count("pathetic") > 280
    assert model.readings("then,") == ["then"] and model.readings("1234") == ["1234"]


def test_clean_keeps_columns(spark, learnt):
    d, lab, scorer, truth = learnt
    kept = tox.clean(d, lab)
    assert kept.schema == d.schema
    ids = {r["doc_id"] for r in kept.collect()}
    gone = {r["doc_id"] for r in tox.scored(d, scorer).collect() if r["predicted"]}
    assert ids | gone == {r["doc_id"] for r in d.collect()} and not (ids & gone - {5})


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "a b", "x", 0.0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r["predicted"] for r in tox.toxicity(d, none).collect()] == [0]
    assert tox.toxicity(d.limit(0), none).collect() == []


def test_workers_forget_what_tasks_knew(spark):
    """a worker that lives on holds no token of a stage that has ended."""
    docs = spark.createDataFrame([(k, f"w{k} some other words", ) for k in range(200)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    assert tox.toxicity(docs, labels).count() == 200
    held = spark.range(8, numPartitions=8).mapInPandas(lambda it: (p.assign(id=tox.hash_64.cache_info().currsize) for p in it), "id long")
    assert [r["id"] for r in held.collect()] == [0] * 8
    scorer = tox.Scorer(None, {"a": 1.0})
    scorer._known["a"] = 1.0
    scorer.forget()
    assert not scorer._known
