import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from revlens.llm import bpe

RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, k int"


def texts():
    rng = random.Random(3)
    parts = ["a", "don't", "'ll", "'re", "  ", " ", "\n", "\t\n", "12", "²", "...", "é", "ß", "漢字", "😀", " ", "word", "<|endoftext|>", "　", "aaaaaaa", "''s", "Ⅷ"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    out += [None, "", " ", "x" * 3000, "ab " * 30_000, "y" * 70_000, "né" * 50_000 + " end", "\n" * 80_000 + "z", ("wörd don't  " * 7000)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    return spark.createDataFrame([(i, x, "no", 1) for i, x in enumerate(t)] + [(3, "again", None, None)], SCHEMA).repartition(3), [(i, x) for i, x in enumerate(t)] + [(3, "again")]


def test_encoding_is_the_librarys(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, x in docs[1]:
        ids = enc.encode_ordinary(x or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    for kw in ({}, {"chunk": 64, "overlap": 16, "long_text": 100}):
        got = [tuple(r) for r in bpe.encoded(docs[0], RANKS, **kw).collect()]
        assert sorted(got) == sorted(want)


def test_packed_files_give_the_librarys_ids(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(MODEL)
    want, at = {}, 0
    for i, x in sorted(docs[1], key=lambda r: r[0]):
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    parts = bpe.packed_files(docs[0], MODEL, 2, f"file://{tmp_path}", length=32)
    got = sorted(tuple(r) for r in bpe.read_packed(spark, parts).collect())
    assert sorted((i, n, c) for i, _, n, c in got) == sorted((i, *x) for i, v in want.items() for x in v)
    run = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == run
        run += n
    assert run == at
    f = bpe.Packed(f"{parts[0]['name']}.ids.arrow")
    ids, mask = f[len(f) - 1]
    assert len(ids) == 32 and sum(int(f[i][1].sum()) for i in range(len(f))) == parts[0]["n_tokens"]
    assert not ids[~mask.astype(bool)].any()


def test_counts_are_the_librarys(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(MODEL)
    want = [(i, len((x or "").encode()), n := len(tok.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in docs[1]]
    assert sorted(tuple(r) for r in bpe.token_counts(docs[0], MODEL).collect()) == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.encoded(none, RANKS).collect() == bpe.packed(none, MODEL).collect() == bpe.token_counts(none, MODEL).collect() == []


def test_chunks_stitch_where_boundaries_meet():
    from revlens.llm.pretoken import Slice

    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "  ", "'re", "'", "1", ".", "é", "\n", "漢"]) for _ in range(rng.randrange(1, 200)))
        data = np.frombuffer(text.encode(), np.uint8)
        want = Slice(data, np.zeros(1, np.int64)).starts
        pieces = [(a, b, Slice(data[a:b], np.zeros(1, np.int64)).starts + a) for a, b in bpe.chunked(data, rng.randrange(20, 40), rng.randrange(4, 19))]
        assert bpe.stitched(data, pieces).tolist() == want.tolist()


def test_a_very_long_text_takes_linear_time(spark):
    """16 MB of words, and 4 MB without a boundary, within a minute."""
    import time

    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(1, 12))) for _ in range(5_000)]
    text = " ".join(rng.choice(words) for _ in range(2_300_000))
    d = spark.createDataFrame([(1, text), (2, "ab" * 2_000_000)], "doc_id long, text string")
    begun = time.time()
    got = {r["doc_id"]: r for r in bpe.encoded(d, RANKS, with_ids=True).collect()}
    assert time.time() - begun < 60
    assert got[1]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[2]["decoded_sha256"] == hashlib.sha256(("ab" * 2_000_000).encode()).hexdigest()
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    assert got[1]["ids"] == tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


def test_null_ids(spark):
    d = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_tokens"]) for r in bpe.encoded(d, RANKS).collect()} == {(None, 2), (1, 0)}
    assert {(r["doc_id"], r["n_tokens"]) for r in bpe.token_counts(d, MODEL).collect()} == {(None, 2), (1, 0)}
    assert {(r["doc_id"], r["n_tokens"]) for r in bpe.packed(d, MODEL).collect()} == {(None, 3), (1, 1)}


def test_several_added_strings(spark, tmp_path):
    """As the library: the leftmost, then the longest."""
    import json

    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(MODEL)
    tok.add_special_tokens(["<|x|>", "<|x|><|y|>"])
    tok.add_tokens([AddedToken("zqzq", normalized=False)])
    at = f"{tmp_path}/more.json"
    tok.save(at)
    assert len(json.load(open(at))["added_tokens"]) >= 3
    rng = random.Random(8)
    texts = ["".join(rng.choice(["<|x|>", "<|y|>", "zqzq", "zq", "a b", " ", "é"]) for _ in range(rng.randrange(1, 12))) for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(d, at).collect()} == {i: len(x) for i, x in want.items()}
    assert {r["doc_id"]: r["ids_crc32"] for r in bpe.packed(d, at).collect()} == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in want.items()}
