"""Chat formatting into a prefix tree (operator 10).

Conversations that begin with the same turns share the nodes of those turns. Nodes are laid out once,
depth first, in one long stream of tokens (here: code points of the formatted text); each node carries
the position id of its first token, which counts from the conversation's start, and the intervals of the stream that
its tokens may attend to besides their own node: those of its ancestors.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.common import forget, modest_batches, new_path, shuffles_dropped, written

HEAD, COLON, END = "### ", ": ", "</turn>\n"
_ESCAPED, _BACK = re.compile(r"[\\#<:\n]"), re.compile(r"\\(.)", re.S)


def escape(text: str, every: bool = False) -> str:
    """Backslashes what a control string of the template can begin with; every: also what can end a role."""
    if every:
        return _ESCAPED.sub(r"\\\g<0>", text)
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head = HEAD + escape(role, True) + COLON
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


_TURN = re.compile(r"### ((?:\\.|[^\\#<:\n])*): ((?:\\.|[^\\#<])*)</turn>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation at {at}")
    return out


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row per turn with its node in the tree: cid (a number of the conversation's own), conv_id, k, node, pos, n, text, loss_from, loss_to, and in each conversation's last row key, all of its nodes."""
    schema = "cid long, conv_id long, k int, node binary, pos long, n int, text string, loss_from int, loss_to int, key binary"
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def one(cid, conv_id, turns):
        """turns: (role, text) of a conversation in order."""
        h, pos, out, ends = b"", 0, [], []
        for k, (role, text) in enumerate(turns):
            formatted, a, b = render(role, text)
            h = hashlib.blake2b(h + formatted.encode(), digest_size=16).digest()
            ends.append(h)
            loss = (a, b) if role == "assistant" else (0, 0)
            out.append([cid, conv_id, k, h, pos, len(formatted), formatted, *loss, None])
            pos += len(formatted)
        out[-1][-1] = b"".join(ends)
        return out

    def run(batches):
        from pyspark import TaskContext

        cid = TaskContext.get().partitionId() << 33
        now, held, ready, size, begun = None, [], [], 0, False

        def shaped():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if begun and c != now:
                    ready += one(cid, now, held)
                    cid, held = cid + 1, []
                    if size >= 4 << 20:
                        yield shaped()
                        ready, size = [], 0
                now, begun = c, True
                held.append((role, text))
                size += len(text) + 100
        if begun:
            ready += one(cid, now, held)
            yield shaped()

    return rows.mapInArrow(run, schema)


def in_order(df: DataFrame, by: list[str], keep: list[str], kinds: str) -> DataFrame:
    """df in the global order of by, with part and i, the places of the range and within it."""

    def run(batches):
        from pyspark import TaskContext

        part, i = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int64)), pa.array(np.arange(i, i + m)), *(batch.column(c) for c in range(len(keep)))], ["part", "i", *keep])
            i += m

    return df.repartitionByRange(*by).sortWithinPartitions(*by).select(*keep).mapInArrow(run, f"part long, i long, {kinds}")


def formatted(conversations: DataFrame, to: str | None = None) -> str:
    """Writes the tree of all conversations (conv_id, turn, role, text) into a folder and returns it.

    <to>/nodes: start, end (in the stream of all tokens), pos (position id of the first token), text, loss_from and
    loss_to (the part under the loss mask, relative to the text), attends (merged intervals of the ancestors).
    <to>/conversations: conv_id, path (start of each of its nodes, in order).
    Conversations are put in the order of their nodes; a node stands where the first of its conversations does, so that the stream is
    depth first at any depth. Rows are ordered by turn, ties by role and text; null texts and roles count as empty; rows of a null conv_id are
    one conversation; equal rows count as often as they stand. Other columns are ignored. An empty table gives empty ones.
    """
    spark = conversations.sparkSession
    modest_batches(spark)
    to = to or new_path(spark, "chat")
    turns = written(turns_of(conversations), "turns")
    ranked = in_order(turns.where("key is not null").select("cid", "key"), ["key", "cid"], ["cid"], "cid long")  # equal conversations are dealt out, too
    ranked = written(ranked.select("cid", (F.col("part") * F.lit(1 << 33) + F.col("i")).alias("seq")), "ranked")
    light = written(turns.select("cid", "k", "node", "n").join(ranked, "cid"), "light")
    # each node once, without its text; partial aggregation takes the heat out of common first turns
    nodes = light.groupBy("node").agg(F.min("seq").alias("seq"), F.first("k").alias("k"), F.first("n").alias("n"))
    laid = written(in_order(nodes, ["seq", "k"], ["node", "seq", "n"], "node binary, seq long, n int"), "laid")
    # what stands before each range: one number for each partition
    totals = sorted((r["part"], r["n"]) for r in laid.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, at = [], 0
    for part, n in totals:
        before.append((part, at))
        at += n
    base = F.broadcast(spark.createDataFrame(before or [(-1, 0)], "part long, base long"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("i")) - F.col("n")
    placed = written(laid.withColumn("start", within).join(base, "part").select("node", F.col("seq").alias("first"), (F.col("base") + F.col("start")).alias("start")), "placed")
    steps = light.join(placed, "node").select("cid", "k", "start", "n", (F.col("first") == F.col("seq")).alias("own"))
    steps = steps.repartition("cid").sortWithinPartitions("cid", "k")
    schema = "cid long, k int, path array<long>, start long, attends array<array<long>>"
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.list_(pa.int64()))]

    def attend(batches):
        now, spans, path, rows = None, [], [], []

        def shaped():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["cid", "k", "path", "start", "attends"])

        for batch in batches:
            for c, k, start, n, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if c != now and now is not None:
                    rows.append((now, None, path, None, None))
                    spans, path = [], []
                now = c
                if own:
                    rows.append((c, k, None, start, [list(s) for s in spans]))
                if spans and spans[-1][1] == start:
                    spans[-1][1] = start + n
                else:
                    spans.append([start, start + n])
                path.append(start)
            if len(rows) >= 5000:
                yield shaped()
                rows = []
        if now is not None:
            rows.append((now, None, path, None, None))
            yield shaped()

    both = written(steps.mapInArrow(attend, schema), "steps")
    forget(ranked, light, laid, placed)
    ids = turns.where("key is not null").select("cid", "conv_id")
    own = both.where("start is not null").select("cid", "k", "start", "attends")
    out = turns.select("cid", "k", "pos", "n", "text", "loss_from", "loss_to").join(own, ["cid", "k"])
    with shuffles_dropped(spark):
        both.where("path is not null").select("cid", "path").join(ids, "cid").select("conv_id", "path").write.parquet(f"{to}/conversations")
        out.select("start", (F.col("start") + F.col("n")).alias("end"), "pos", "text", "loss_from", "loss_to", "attends").write.parquet(f"{to}/nodes")
    forget(turns, both)
    return to


def read_back(spark, at: str) -> DataFrame:
    """Per conversation what formatted() has written of it: turns parsed from the text, and what lies under the loss mask.

    A row a conv_id, null for the conversation of rows without one; equal turns count as often as they were written, in their order; null and empty texts are turns of no characters. A
    conversation is read turn by turn, so that none is held whole. Other files in the folder are ignored; a tree without conversations gives an empty result.
    """
    nodes = spark.read.parquet(f"{at}/nodes").select("start", "text", "loss_from", "loss_to")
    steps = spark.read.parquet(f"{at}/conversations").select("conv_id", F.posexplode("path").alias("k", "start"))
    rows = steps.join(nodes, "start").select("conv_id", "k", "text", "loss_from", "loss_to")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "k")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def digest(conv_id, parts):
        text = "".join(p[0] for p in parts)
        turns = parse(text)
        loss = "".join(unescape(t[a:b]) for t, a, b in parts)
        return conv_id, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        now, begun, parts, rows = None, False, [], []

        def shaped():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            for c, *part in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if begun and c != now:
                    rows.append(digest(now, parts))
                    parts = []
                now, begun = c, True
                parts.append(part)
            if len(rows) >= 5000:
                yield shaped()
                rows = []
        if begun:
            rows.append(digest(now, parts))
        if rows:
            yield shaped()

    return rows.mapInArrow(run, schema)
