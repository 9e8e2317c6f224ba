import random

from pyspark.sql import functions as F

from revlens.llm import lines as L

SCHEMA = "doc_id long, text string, line string, id long, n_chars long"


def docs(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    out = []
    for i in range(120):
        ls = []
        for _ in range(rng.randrange(1, 8)):
            k = rng.random()
            x = rng.choice(base).split() if k < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(1, 40))]
            if k < 0.25 and len(x) > 20:
                x[rng.randrange(len(x))] = "changed"
            ls.append(" ".join(x))
        out.append((i, "\n".join(ls)))
    return out + [(200, None), (201, ""), (202, "\n\n"), (203, "a\nA\n b"), (204, out[3][1]), (205, " " + out[4][1].upper()), (206, "z" * 50_000), (207, "é ß 漢字 x y z w v u")]


def brute(rows, share=0.75):
    first, places = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for no, line in enumerate((t or "").split("\n")):
            x = line.strip(" ").lower()
            places[d, no] = x
            if x:
                first.setdefault(x, (d, no))
    texts = list(first)
    up = {x: x for x in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {x: windows(x) for x in texts if len(x) >= L.SHINGLE}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if a in sets and b in sets:
                o = len(sets[a] & sets[b])
                if o and o >= share * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    if x != y:
                        up[max(x, y, key=first.get)] = min(x, y, key=first.get)
    return {k: not x or first[root(x)] == k for k, x in places.items()}


def test_against_brute_force(spark):
    rows = docs()
    d = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in rows], SCHEMA).repartition(3)
    want = brute(rows)
    for checked in (1000, 0):
        got = {}
        for r in L.decisions(d, checked=checked).collect():
            assert r["n_kept"] == r["n_lines"] - len(r["dropped"])
            got |= {(r["doc_id"], n): n not in r["dropped"] for n in range(r["n_lines"])}
        assert got.keys() == want.keys()
        assert sum(got[k] != want[k] for k in want) <= 0.01 * len(want)


def test_texts(spark):
    rows = docs()
    d = spark.createDataFrame([(i, t, "x", 1, len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    dec = {r["doc_id"]: set(r["dropped"]) for r in L.decisions(d).collect()}
    out = L.deduplicated(d)
    assert out.schema.names == d.schema.names
    assert sorted(map(str, L.deduplicated(d, sent=0).collect())) == sorted(map(str, out.collect()))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in rows:
        kept = [x for n, x in enumerate((t or "").split("\n")) if n not in dec[i]]
        if dec[i] and not "".join(kept).strip():
            assert i not in got
        else:
            assert got[i] == ("\n".join(kept) if t is not None else None)
    assert 204 not in got and 200 in got and 201 in got and 202 in got


def test_none(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert L.decisions(d).collect() == L.deduplicated(d).collect() == []


def windows(x):
    return frozenset(x[k : k + L.SHINGLE] for k in range(len(x) - L.SHINGLE + 1))


def test_every_window_counts(spark):
    lines = ["answer: yes", "answer: no", "chapter one", "chapter twelve", "https://a.example/first", "https://b.example/other", "中文字符没有空格的一行甲乙丙丁戊己庚辛", "中文字符没有空格的另外一句子丑寅卯辰巳午"]
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(400))
    lines += ["0" + long, "1" + long, "x" * 71 + long]  # unspaced: near copies, and no copy's windows begin a word
    rows = [(i, x) for i, x in enumerate(lines)]
    d = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in rows], SCHEMA).repartition(3)
    gone = {r["doc_id"] for r in L.decisions(d).collect() if r["dropped"]}
    sets = [windows(x) for x in lines]
    assert gone == {j for j in range(len(lines)) if any(len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]) for i in range(j))} == {9, 10}


def test_windows_of_any_characters(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aé漢😀 b") for _ in range(n)) for n in (7, 8, 9, 23, 301)]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "cid long, norm string")
    got = {r["norm"]: (r["n"], r["m"]) for r in L.windows(d).groupBy("cid").agg(F.collect_set("h").alias("h")).join(d, "cid").select("norm", F.size("h").alias("n"), F.size(L.shingles(F.col("norm"))).alias("m")).collect()}
    assert got == {t: (len(windows(t)), len(windows(t))) for t in texts if len(t) >= L.SHINGLE}


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))


def test_families_in_one_bucket(spark):
    rng = random.Random(5)
    shared, texts, family = [word(rng) for _ in range(40)], [], []
    for k in range(60):  # a passage that all share, and words of the family's own; each line has one word of its own
        base = shared + [word(rng) for _ in range(10)]
        for _ in range(3):
            x = list(base)
            x[rng.randrange(50)] = word(rng)
            texts.append(" ".join(x))
            family.append(k)
    order = list(range(len(texts)))  # numbers of classes say nothing about families
    rng.shuffle(order)
    texts, family = [texts[k] for k in order], [family[k] for k in order]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "cid long, norm string").repartition(3)
    sets = [windows(t) for t in texts]
    n = range(len(texts))
    want = {(a, b) for a in n for b in n if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    keys = d.select("cid", F.lit(1).cast("long").alias("key"), F.lit(len(texts)).cast("long").alias("n"))  # one bucket of all
    met = {tuple(sorted((r["a"], r["b"]))) for r in L.candidates(keys).collect()}
    assert all(a < b for a, b in met) and len(met) <= (L.LEADS + 1) * len(texts)
    assert len(want) > 100 and met and len(want & met) < 0.2 * len(want)
    alone = keys.withColumn("comp", F.col("cid"))
    twice = alone.union(alone.withColumn("key", F.lit(2).cast("long")))
    for block in (128, 25):
        for mixed in (alone, twice):
            got = [tuple(r) for r in L.rest(mixed, d, 0.8, block).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    comp = spark.createDataFrame([(k, min(j for j in n if family[j] == family[k])) for k in n], "node long, comp long")
    mixed = L.across(keys, comp)
    assert {tuple(r) for r in L.rest(mixed, d, 0.8).collect()} == {(a, b) for a, b in want if family[a] != family[b]}


def test_all_pairs_of_the_bands(spark):
    rng = random.Random(6)
    shared, rows = [word(rng) for _ in range(40)], []
    for _ in range(150):
        base = shared + [word(rng) for _ in range(12)]
        x = list(base)
        x[rng.randrange(40)] = word(rng)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(x))]
    d = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in rows], SCHEMA).repartition(3)
    got = {r["doc_id"] for r in L.decisions(d, 0.85).collect() if r["dropped"]}
    sets = [windows(t) for _, t in rows]
    dropped = {j for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])}
    assert got <= dropped and len(got) >= 0.99 * len(dropped) > 100


def test_recall_of_pairs(spark):
    """Pairs at 0.75 to 0.8 that share a boilerplate beginning with all others, against all pairs."""
    rng = random.Random(7)
    shared, rows = [word(rng) for _ in range(12)], []
    while len(rows) < 600:
        base = shared + [word(rng) for _ in range(24)]
        x = list(base)
        for _ in range(rng.randrange(3, 6)):
            x[rng.randrange(12, 36)] = word(rng)
        a, b = windows(" ".join(base)), windows(" ".join(x))
        if 0.75 <= len(a & b) / len(a | b) < 0.8:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(x))]
    d = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in rows], SCHEMA).repartition(3)
    gone = {r["doc_id"] for r in L.decisions(d).collect() if r["dropped"]}
    assert gone <= set(range(1, 600, 2)) and len(gone) >= 0.95 * 300


def test_clashing_names(spark):
    kept = "kept line of the text"
    d = spark.createDataFrame([(1, f"{kept}\nother words here", 5, "q"), (2, f"{kept}\nmore of something", 6, "r"), (None, None, 7, "s")], "doc_id long, text string, of long, dropped string")
    out = L.deduplicated(d)
    assert out.schema == d.schema
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, f"{kept}\nother words here", 5, "q"), (2, "more of something", 6, "r"), (None, None, 7, "s")], key=str)
