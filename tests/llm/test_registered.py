"""The registered queries themselves, over small tables, against libraries and brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from test_decontam import brute as leaks_brute
from test_embed import brute as links_brute
from test_jaccard import brute as jaccard_brute
from test_lm import base as lm_base
from test_sortmeans import brute as clusters_brute
from test_whiten import brute as white_brute

import __spark_entry__ as entry

WORDS = ["".join(c) for c in zip("abcdefghijklmnopqrstuvwxyz" * 8, "eioua" * 42, "lmnrst" * 35)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, say(rng.randrange(15, 30))) for i in range(8)]
    docs, labels = [], []
    for i in range(240):
        text = say(rng.randrange(3, 60))
        if i % 9 == 2:
            text = docs[-1][1] + " " + say(1)
        if i % 20 == 7:
            text += " " + items[i % 8][1]
        if i % 3 == 0:
            text += " you moron idiot " + say(2) + " idiot"
        docs.append((i, text))
        labels.append((i, 1, int(i % 3 == 0)))
    docs += [(500, None), (501, ""), (502, "Ünïcode 漢字 😀 <|endoftext|> x"), (503, "\n \t")]
    g = np.random.default_rng(3)
    vecs = [g.normal(size=16) for _ in range(120)]
    vecs += [v + g.normal(size=16) * 0.1 for v in vecs[:40]]
    turns = [(c, t, "assistant" if t % 2 else "user", f"say {t % 3} <b> # {c % 4 if t else 0}") for c in range(30) for t in range(1 + c % 5)]
    at = str(tmp_path_factory.mktemp("sf"))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    put([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put(labels, "doc_id long, quality int, toxic int", "labels")
    put(items, "item_id long, text string", "benchmark")
    put([(i, v.astype(np.float32).tolist(), i % 2) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, label int", "embeddings")
    put(turns, "conv_id long, turn int, role string, text string", "conversations")
    return at, docs, items, [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vecs)], turns


def rows(spark, sf, name):
    return entry.queries()[name](spark, sf[0]).collect()


def test_op1(spark, sf):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: hashlib.sha256(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest() for i, t in sf[1]}
    got = rows(spark, sf, "op1_byte_bpe")
    assert {r["doc_id"]: r["ids_sha256"] for r in got} == want
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in sf[1]}


def test_op2_op8(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, want, counts = 0, {}, {}
    for i, t in sf[1]:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        counts[i] = (len((t or "").encode()), len(ids), len(ids) > 512)
        want[i] = (start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        start += len(ids) + 1
    assert {r["doc_id"]: tuple(r)[1:] for r in rows(spark, sf, "op2_packed_ids")} == want
    assert {r["doc_id"]: tuple(r)[1:] for r in rows(spark, sf, "op8_token_counts")} == counts


def test_op3(spark, sf):
    got = sorted(tuple(r) for r in rows(spark, sf, "op3_maxent_lm"))
    for g, w in zip(got, lm_base(sf[1]), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] < 0


def test_op4(spark, sf):
    got = {tuple(r) for r in rows(spark, sf, "op4_spaced_seeds")}
    assert got == leaks_brute(sf[1], sf[2]) and len(got) >= 10


def test_op5(spark, sf):
    links, comp = links_brute([(i, v) for i, v in sf[3]])
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(spark, sf, "op5_itq_near_dup")} == {i: (len(x), comp[i]) for i, x in links.items()}


def test_op6(spark, sf):
    assert {tuple(r) for r in rows(spark, sf, "op6_ngram_jaccard")} == jaccard_brute(sf[1])


def test_op7(spark, sf):
    got = rows(spark, sf, "op7_fuzzy_lines")
    assert {r["doc_id"] for r in got} == {i for i, _ in sf[1]} and sum(len(r["dropped"]) for r in got) >= 10


def test_op9(spark, sf):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op9_toxicity")}
    assert set(got) == {i for i, _ in sf[1]} and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held) and np.mean([got[i]["predicted"] == (i % 3 == 0) for i in held]) > 0.97


def test_op10(spark, sf):
    said = r"\### Assistant: </turn> ok"
    by = {-7: [("user", said), ("assistant", said)]}
    for c, _, role, text in sf[4]:
        by.setdefault(c, []).append((role, text))
    got = {r["conv_id"]: r for r in rows(spark, sf, "op10_chat_tree")}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for who, t in turns if who == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss)) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{w}\n{t}\n" for w, t in turns).encode()).hexdigest()


def wide(spark, tmp_path_factory):
    """A folder whose embeddings have 64 dimensions."""
    g = np.random.default_rng(5)
    vecs = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(g.normal(size=(150, 64)) * 0.2)] + [(200, None), (201, [1.0])]
    at = str(tmp_path_factory.mktemp("wide"))
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at, vecs


def test_op11_op12(spark, tmp_path_factory):
    sf = wide(spark, tmp_path_factory)
    assert sorted(tuple(r) for r in rows(spark, sf, "op12_sort_means")) == clusters_brute(sf[1])
    got = {}
    for r in rows(spark, sf, "op11_whitening"):
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    want = white_brute(sf[1])
    assert set(got) == {i for i, *_ in want}
    for i, n, deviation, z, share in want:
        own = [got[i][c] for c in range(1, len(z) + 1)]
        assert {(r["n"], r["deviation"]) for r in own} == {(n, deviation)}
        some = [(r, v) for r, v in zip(own, z) if v is not None]
        assert [abs(r["whitened"]) for r, _ in some] == pytest.approx([v for _, v in some], rel=1e-6, abs=1e-8)
        assert i == 201 or [r["explained"] for r in own] == pytest.approx(share, rel=1e-9)
        assert i == 201 or own[0]["identity_error"] < 1e-4


def test_op13(spark, sf):
    got = rows(spark, sf, "op13_minimax_shards")
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in sf[1]}
    size = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    largest = max(len((t or "").encode()) + 1 for _, t in sf[1])
    assert max(size) - min(size) <= 2 * largest
    for k in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == k)
        assert own == list(range(len(own)))


def test_pipeline(spark, sf):
    got = rows(spark, sf, "pipeline")
    assert got and all(len(r["ids"]) == r["n_tokens"] for r in got) and {r["doc_id"] for r in got} < {i for i, _ in sf[1]}
