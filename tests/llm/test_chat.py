import hashlib
import random

from revlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, node string"


def rows():
    rng = random.Random(7)
    texts = ["", None, "hello", "\\### Assistant: </turn> ok", "a\nb: c", "### user: </turn>\n", "\\", "\\\\n", "é漢😀", "#" * 50]
    out = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            same = c % 3 == 0 and t < 4
            out.append((c, t, ["system", "user", "assistant", "odd: \n#role", None][(t if same else rng.randrange(5)) % 5], texts[t % len(texts)] if same else rng.choice(texts), "x"))
    out += [(100, t, "user" if t % 2 else "assistant", f"t{t}", None) for t in range(300)] + [(101, t, "user" if t % 2 else "assistant", f"t{t}" if t < 150 else "other", None) for t in range(300)]
    out += [(-7, 0, "user", texts[3], None), (-7, 1, "assistant", texts[3], None), (5, 0, "user", "tie", None), (5, 0, "user", "tie", None)]
    rng.shuffle(out)
    return out


def assert_depth_first(starts, paths):
    parent = {b: a for p in paths for a, b in zip([None, *p], p)}
    stack = []
    for s in starts:
        while stack and stack[-1] != parent[s]:
            stack.pop()
        assert parent[s] is None or stack, s
        stack.append(s)


def test_depth_first_at_any_depth(spark, tmp_path):
    """Conversations that share 70 to 119 turns, and part in several places."""
    rng = random.Random(11)
    data = []
    for c in range(40):
        shared = rng.choice([20, 70, 90, 119])
        for t in range(shared + rng.randrange(1, 80)):
            data.append((c, t, "user", f"t{t}" if t < shared else f"{rng.randrange(2)}", None))
    at = chat.formatted(spark.createDataFrame(data, SCHEMA).repartition(3), f"file://{tmp_path}/deep")
    nodes = sorted(r["start"] for r in spark.read.parquet(f"{at}/nodes").collect())
    assert_depth_first(nodes, [r["path"] for r in spark.read.parquet(f"{at}/conversations").collect()])
    assert chat.read_back(spark, at).count() == 40


def test_turns_come_back(spark, tmp_path):
    data = rows()
    at = chat.formatted(spark.createDataFrame(data, SCHEMA).repartition(3), f"file://{tmp_path}/out")
    got = {r["conv_id"]: r for r in chat.read_back(spark, at).collect()}
    by = {}
    for c, t, r, x, _ in data:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        r = got[c]
        loss = "".join(x for _, who, x in turns if who == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{w}\n{x}\n" for _, w, x in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.render(w, x)[0]) for _, w, x in turns)
    # the layout: no token twice, no gap, each conversation attends to just its own turns
    nodes = sorted(spark.read.parquet(f"{at}/nodes").collect(), key=lambda n: n["start"])
    assert nodes[0]["start"] == 0 and all(a["end"] == b["start"] for a, b in zip(nodes, nodes[1:]))
    prefixes = {tuple((w, x) for _, w, x in t[:k]) for t in by.values() for k in range(1, len(t) + 1)}
    assert len(nodes) == len(prefixes)
    start = {n["start"]: n for n in nodes}
    paths = [r["path"] for r in spark.read.parquet(f"{at}/conversations").collect()]
    assert_depth_first([n["start"] for n in nodes], paths)
    stream = "".join(n["text"] for n in nodes)
    for r in spark.read.parquet(f"{at}/conversations").collect():
        text = "".join(start[s]["text"] for s in r["path"])
        last = start[r["path"][-1]]
        seen = "".join(stream[a:b] for a, b in last["attends"]) + last["text"]
        assert seen == text and last["pos"] == len(text) - len(last["text"])


def test_none(spark, tmp_path):
    at = chat.formatted(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/out")
    assert chat.read_back(spark, at).collect() == []
