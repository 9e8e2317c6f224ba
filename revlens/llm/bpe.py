"""Byte-level BPE: encoding and decoding (operator 1), packed id files (operator 2) and token counts (operator 8)."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import lean, modest_batches, new_path
from revlens.llm.pretoken import Codec, Slice, gathered, text_slices

OPEN = 0xFFFFFFFF


# ---------------------------------------------------------------- vocabularies


@cache
def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@cache
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it is printable, else the next free code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@cache
def merge_file(path: str) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, int]]:
    """(vocabulary, merges in rank order, added strings) of a tokenizers .json file of a byte-level BPE. Added strings, special or not, are looked for as they stand; those that ask for more (a normalised text, no neighbours in a word, stripped white space) are refused."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
    added = j.get("added_tokens", [])
    odd = [t["content"] for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or (t.get("normalized") and j.get("normalizer"))]
    if odd:
        raise ValueError(f"merge_file: added strings with conditions: {odd}")
    return j["model"]["vocab"], merges, {t["content"]: t["id"] for t in added}


@cache
def rank_codec(path: str) -> Codec:
    """Codes single pre-tokens by a rank file."""
    import tiktoken

    one = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=rank_file(path), special_tokens={})._encode_single_piece
    return Codec(lambda pieces: [np.array(one(p), np.uint32).tobytes() for p in pieces], most=100_000)


@cache
def model_codec(path: str) -> Codec:
    """Codes single pre-tokens by the model of a tokenizers .json file; special strings get their own ids."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    table = str.maketrans({chr(b): c for b, c in byte_letters().items()})
    special = {k.encode(): np.array([v], np.uint32).tobytes() for k, v in merge_file(path)[2].items()}
    pack = np.array

    def encode(pieces):
        out = []
        for p in pieces:
            if p in special:
                out.append(special[p])
            else:
                out.append(pack([t.id for t in model.tokenize(p.decode("latin-1").translate(table))], np.uint32).tobytes())
        return out

    return Codec(encode)


class RankMerger:
    """Merges of many pre-tokens at once: ragged arrays of symbols, in each round every sequence's lowest-rank pair, all its places together.

    A pair that holds a symbol made in a round ranks after that round's pair, so merging all
    places of the lowest pair at once gives what merging them from the left, one by one, gives;
    where places overlap (a run of one symbol) every second one counts, from the left.
    """

    def __init__(self, path: str):
        vocab, merges, special = merge_file(path)
        self.special = {k.encode() for k in special}
        self.first = np.array([vocab[byte_letters()[b]] for b in range(256)], np.int64)
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order, made
        self.none = len(merges)
        # pairs of single bytes fill most first rounds: a direct table for small ids
        self.small = 512
        self.direct = np.full(self.small * self.small, self.none, np.int32)
        a, b = key >> 20, key & 0xFFFFF
        low = (a < self.small) & (b < self.small)
        self.direct[a[low] * self.small + b[low]] = np.flatnonzero(low)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.full(len(left), self.none, np.int64)
        low = (left < self.small) & (right < self.small)
        out[low] = self.direct[left[low] * self.small + right[low]]
        rest = np.flatnonzero(~low)
        if len(rest):
            key = (left[rest] << 20) | right[rest]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[rest] = np.where(self.key[at] == key, self.rank[at], self.none)
        return out

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols survive in each piece."""
        out = np.array([1 if p in self.special else 0 for p in pieces], np.int64)
        todo = np.flatnonzero(out == 0)
        lens = np.array([len(pieces[i]) for i in todo], np.int64)
        sym = self.first[np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)]
        seq = np.repeat(np.arange(len(todo)), lens)
        pair = np.full(len(sym), self.none, np.int64)  # of each symbol with its right neighbour
        same = np.flatnonzero(seq[1:] == seq[:-1])
        pair[same] = self.ranks(sym[same], sym[same + 1])
        final = np.zeros(len(todo), np.int64)
        while len(sym):
            head = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(pair, head)
            size = np.diff(np.append(head, len(sym)))
            done = low == self.none
            final[seq[head[done]]] = size[done]
            keep = np.repeat(~done, size)
            if not keep.all():
                sym, seq, pair = sym[keep], seq[keep], pair[keep]
                low, size = low[~done], size[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(pair == np.repeat(low, size))
            if len(hit) > 1:
                # of touching places (a run of one symbol) every second one, from the left
                run = np.append(True, np.diff(hit) != 1)
                at = np.flatnonzero(run)
                hit = hit[(np.arange(len(hit)) - np.repeat(at, np.diff(np.append(at, len(hit))))) % 2 == 0]
            sym[hit] = self.made[pair[hit]]
            live = np.ones(len(sym), bool)
            live[hit + 1] = False
            sym, seq, pair = sym[live], seq[live], pair[live]
            hit = hit - np.arange(len(hit))  # each earlier hit took one place
            touched = np.unique(np.concatenate([hit, hit[hit > 0] - 1]))
            pair[touched] = self.none
            inner = touched[touched + 1 < len(sym)]
            inner = inner[seq[inner] == seq[inner + 1]]
            pair[inner] = self.ranks(sym[inner], sym[inner + 1])
        out[todo] = final
        return out


@cache
def merger(path: str) -> RankMerger:
    return RankMerger(path)


@cache
def token_bytes(path: str) -> tuple[list[bytes], np.ndarray]:
    ranks = rank_file(path)
    out = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        out[v] = k
    return out, np.array([len(x) for x in out], np.int64)


# ---------------------------------------------------------------- operator 1


#: Boundaries that end within so many bytes of a chunk's end may move with what follows.
SLACK = 12


def meeting(known: np.ndarray, starts: np.ndarray, edge: int) -> int | None:
    """The first boundary that a text's own (known) and those of its next chunk (starts, the first of them the chunk's own begin) have in common, before the
    end of what both have seen. From there on matches depend on what follows only, so both go on alike. The chunk's begin is no evidence; what ends near the edge may still move."""
    known = known[: np.searchsorted(known, edge - SLACK, "right")]
    shared = np.intersect1d(known[np.searchsorted(known, starts[0], "right") :], starts, assume_unique=True) if len(starts) else known[:0]
    return int(shared[0]) if len(shared) else None


def stitched(text: np.ndarray, pieces: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """The first bytes of a text's pre-tokens out of overlapping chunks: (first byte, end, first bytes of the chunk's pre-tokens), in order, all counted in the text.

    Where no boundaries meet (a pre-token longer than the overlap), what follows is cut anew from the last sure one, each time twice as far, so that
    the whole takes linear time.
    """
    out: list[np.ndarray] = []
    _, edge, now = pieces[0]
    k = 1
    while k < len(pieces):
        a, end, starts = pieces[k]
        p = meeting(now[:-1], starts, edge)
        if p is not None:
            out.append(now[: np.searchsorted(now, p)])
            now, edge = starts[np.searchsorted(starts, p) :], end
            k += 1
            continue
        sure = max(0, min(int(np.searchsorted(now, edge - SLACK, "right")), len(now) - 1) - 1)
        p = int(now[sure]) if len(now) else 0
        out.append(now[:sure])
        reach = p + 2 * (end - p)
        while k + 1 < len(pieces) and pieces[k + 1][1] <= reach:
            k += 1
        edge = pieces[k][1]
        now = Slice(text[p:edge], np.zeros(1, np.int64)).starts + p
        k += 1
    return np.concatenate([*out, now])


def chunked(data: np.ndarray, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(first byte, end) of chunks of UTF-8 that share overlap bytes with the next one, never inside a character."""
    out, a, n = [], 0, len(data)
    while True:
        b = min(n, a + chunk + overlap)
        while b < n and data[b] & 0xC0 == 0x80:
            b += 1
        out.append((a, b))
        if b >= n:
            return out
        a += chunk
        while data[a] & 0xC0 == 0x80:
            a += 1


def cut_up(data: np.ndarray, firsts: np.ndarray, chunk: int, overlap: int) -> Slice:
    """A slice of texts that went through chunks: all of them are pre-tokenised side by side, and stitched text by text."""
    spans, of = [], []
    for k, (p, q) in enumerate(zip(firsts.tolist(), np.append(firsts[1:], len(data)).tolist(), strict=True)):
        own = [(p, q)] if q - p <= chunk + overlap else [(a + p, b + p) for a, b in chunked(data[p:q], chunk, overlap)]
        spans += own
        of += [k] * len(own)
    if len(spans) == len(firsts):
        return Slice(data, firsts)
    size = np.array([b - a for a, b in spans], np.int64)
    begin = np.cumsum(size) - size
    s = Slice(np.concatenate([data[a:b] for a, b in spans]), begin)
    cuts = np.append(s.cuts, len(s.starts)).tolist()
    parts, k = [], 0
    while k < len(spans):
        n = k + 1
        while n < len(spans) and of[n] == of[k]:
            n += 1
        pieces = [(a, b, s.starts[cuts[i] : cuts[i + 1]] + (a - int(begin[i]))) for i, (a, b) in enumerate(spans[k:n], k)]
        parts.append(pieces[0][2] if n == k + 1 else stitched(data, pieces))
        k = n
    return Slice(data, firsts, prior=np.concatenate(parts))


def ids_of(s: Slice, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's begin and the last one's end)."""
    index, (lens, flat) = s.coded(rank_codec(path))
    ids, before = gathered(index, lens, flat)
    return ids, before[np.append(s.cuts, len(s.starts))]


def digest(ids: np.ndarray, path: str, step: int = 1 << 20) -> tuple[str, str]:
    """Digests of ids and of the bytes that they decode to, a step at a time."""
    one, two, names = hashlib.sha256(), hashlib.sha256(), token_bytes(path)[0]
    for p in range(0, len(ids), step):
        part = ids[p : p + step]
        one.update(np.ascontiguousarray(part, "<u4").tobytes())
        two.update(b"".join(map(names.__getitem__, part.tolist())))
    return one.hexdigest(), two.hexdigest()


def digests(ids: np.ndarray, cut: np.ndarray, path: str) -> list[tuple[int, str, str]]:
    """(number of ids, digest of ids, digest of decoded bytes) of each text."""
    names, sizes = token_bytes(path)
    raw = b"".join(map(names.__getitem__, ids.tolist()))
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(sizes[ids], out=ends[1:])
    ids, raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), memoryview(raw)
    sha = hashlib.sha256
    return [(int(q - p), sha(ids[4 * p : 4 * q]).hexdigest(), sha(raw[ends[p] : ends[q]]).hexdigest()) for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str, chunk: int = 2_048, overlap: int = 256, long_text: int = 65_536, with_ids: bool = False) -> DataFrame:
    """Encodes each text of docs (doc_id, text) by a rank file and decodes it again.

    Texts over chunk bytes are cut into overlapping chunks, pre-tokenised side by side and stitched. Texts of over long_text characters are dealt
    out as chunks of half of that, which find out where they meet their neighbours and code what is theirs in parallel; per document their ids are joined.
    Only where some neighbours don't meet (a pre-token longer than their overlap) is such a text cut and coded in one task.
    Null texts count as empty: no ids, digests of nothing. Repeated doc_ids stay separate rows, a null doc_id stays null. Other columns
    are ignored. with_ids adds the ids (array<int>). An empty table gives an empty result.
    """
    modest_batches(docs.sparkSession)
    schema = ENCODED + (", ids array<int>" if with_ids else "")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    step = long_text // 2
    shared = min(1_024, step // 2)

    def out(doc_ids, rows, ids, cut):
        cols = [doc_ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    def whole(batches):
        for batch in batches:
            for i, j, data, firsts in text_slices(batch.column(1), 256 << 10):
                ids, cut = ids_of(cut_up(data, firsts, chunk, overlap), path)
                yield out(batch.column(0).slice(i, j - i), digests(ids, cut, path), ids, cut)
                del data, firsts, ids, cut
                pa.default_memory_pool().release_unused()
        rank_codec(path).known.clear()  # the worker lives on in other stages

    def dealt(batches):
        """Each chunk with the one before it and what it shares with the next: own, the bytes of the chunk itself, begin at mid."""
        names = ["row", "doc_id", "k", "n", "mid", "own", "piece"]
        for batch in batches:
            for r, (row, doc_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                text = np.frombuffer(batch.column(2)[r].as_buffer(), np.uint8)
                spans = chunked(text, step, shared)
                first = [a for a, _ in spans] + [len(text)]
                for p in range(0, len(spans), 64):
                    ks = range(p, min(p + 64, len(spans)))
                    cols = [[row] * len(ks), [doc_id] * len(ks), list(ks), [len(spans)] * len(ks), [first[k] - first[max(k - 1, 0)] for k in ks], [first[k + 1] - first[k] for k in ks], [text[first[max(k - 1, 0)] : spans[k][1]].tobytes() for k in ks]]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names)

    def coded(batches):
        """The ids of what lies between the places where a chunk meets its neighbours; null if it doesn't meet one."""
        one = np.zeros(1, np.int64)

        def bounds(piece, mid, own, k, n):
            starts = Slice(piece[mid:], one).starts + mid
            p, q = mid, len(piece)
            if k:
                end = mid + shared
                while end < len(piece) and piece[end] & 0xC0 == 0x80:
                    end += 1
                p = meeting(Slice(piece[:end], one).starts[:-1], starts, min(end, len(piece)))
            if k + 1 < n:
                q = meeting(starts[:-1], Slice(piece[mid + own :], one).starts + (mid + own), len(piece))
            return None if p is None or q is None else (p, q, starts[np.searchsorted(starts, p) : np.searchsorted(starts, q)] - p)

        for batch in batches:
            got = []
            for k, n, mid, own, raw in zip(*(batch.column(c).to_pylist() for c in range(2, 7)), strict=True):
                piece = np.frombuffer(raw, np.uint8)
                found = bounds(piece, mid, own, k, n)
                ids = None if found is None else ids_of(Slice(piece[found[0] : found[1]], one, prior=found[2]), path)[0].astype("<u4").tobytes()
                got.append((raw[mid : mid + own], ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.binary())], ["row", "doc_id", "k", "data", "ids"])
        rank_codec(path).known.clear()

    def joined(key, group):
        order = np.argsort(group.column("k").to_numpy())
        parts = [group.column("ids")[int(i)] for i in order]
        if all(p.is_valid for p in parts):
            ids = np.concatenate([np.frombuffer(p.as_buffer(), "<u4") for p in parts])
        else:
            text = np.concatenate([np.frombuffer(group.column("data")[int(i)].as_buffer(), np.uint8) for i in order])
            ids = ids_of(cut_up(text, np.zeros(1, np.int64), step, shared), path)[0]
        rows = [(len(ids), *digest(ids, path))]
        return pa.Table.from_batches([out(group.column("doc_id").combine_chunks().slice(0, 1), rows, ids, np.array([0, len(ids)]))])

    short = docs.where(F.length("text") <= long_text).mapInArrow(lean(whole), schema)
    long = docs.where(F.length("text") > long_text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    long = long.mapInArrow(lean(dealt), "row long, doc_id long, k int, n int, mid int, own int, piece binary").repartition("row", "k")
    long = long.mapInArrow(lean(coded), "row long, doc_id long, k int, data binary, ids binary").groupBy("row").applyInArrow(joined, schema)
    return short.unionByName(long)


# ---------------------------------------------------------------- operator 2

SEQUENCES = 64


def files_of(uri: str):
    """(file system, path) of a place, given with its scheme (see qualified())."""
    from pyarrow import fs

    if ":/" not in uri:
        raise ValueError(f"files_of: {uri} has no scheme, so workers can't tell where it is")
    return fs.FileSystem.from_uri(uri)


def qualified(spark, path: str) -> str:
    """A path with the scheme that Spark itself would take for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


class Packed:
    """Random access to one file of equal-length sequences. Batches but the last hold SEQUENCES rows; on a local disk nothing is copied."""

    def __init__(self, uri: str):
        system, path = files_of(uri)
        if system.type_name == "local":
            source = pa.memory_map(path)
        else:
            source = system.open_input_file(path).read_buffer()
        with pa.ipc.open_stream(source) as r:
            self.batches = list(r)
        self.length = self.batches[0].column(0).type.list_size if self.batches else 0

    def __len__(self):
        return sum(len(b) for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of a sequence: the ids are a view, the mask is 1 for ids, 0 for padding."""
        b, k = self.batches[i // SEQUENCES], i % SEQUENCES
        n = self.length
        mask = b.column(1).values.slice((b.column(1).offset + k) * n, n)
        return b.column(0).values.to_numpy()[(b.column(0).offset + k) * n :][:n], np.asarray(mask.to_numpy(zero_copy_only=False))

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the file, over sequence and batch borders."""
        per, out = SEQUENCES * self.length, []
        while n > 0:
            b, k = self.batches[start // per], start % per
            x = b.column(0).values.to_numpy()[b.column(0).offset * self.length :][k : k + n]
            out.append(x)
            start, n = start + len(x), n - len(x)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)


def packed_files(docs: DataFrame, path: str, end_id: int, to: str, length: int = 1024) -> list[dict]:
    """Writes the ids of all texts, in ascending doc_id order and each followed by end_id, as Arrow streams in the folder to.

    Per range of doc_ids two files: <k>.ids.arrow with batches of SEQUENCES fixed-size lists (ids, and a mask
    that is false on the padding at the file's end), and <k>.docs.arrow with doc_id, first id in the file and
    number of ids. The ids are uint16 where the vocabulary allows it. A task writes under a name of its own
    attempt and renames at the end, so repeated attempts leave whole files. Returns one entry a range:
    bounded by the number of partitions. Ties of doc_id are ordered by text; null texts are empty and give
    just end_id; a null doc_id comes first. Very long texts are coded whole, in their task.
    """
    modest_batches(docs.sparkSession)
    vocab, _, special = merge_file(path)
    strings = [x.encode() for x in special]
    kind = np.uint16 if max([*vocab.values(), *special.values(), end_id]) < 1 << 16 else np.uint32

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{to}/{task.partitionId():06d}"
        system, ids_at = files_of(f"{name}.ids.arrow")
        docs_at = ids_at.replace(".ids.arrow", ".docs.arrow")
        own = f".{task.taskAttemptId()}"
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        state = None
        total, rest, lo, hi = 0, [], None, None
        block = SEQUENCES * length

        def put(w, flat, n):
            rows = -(-len(flat) // length)
            mask = np.zeros(rows * length, bool)
            mask[:n] = True
            full = np.zeros(rows * length, kind)
            full[: len(flat)] = flat
            w.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(full), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))

        for batch in batches:
            if not len(batch):
                continue
            if state is None:
                system.create_dir(ids_at.rpartition("/")[0], recursive=True)
                f, g = system.open_output_stream(ids_at + own), system.open_output_stream(docs_at + own)
                state = f, g, pa.ipc.new_stream(f, schema), pa.ipc.new_stream(g, doc_schema)
            doc_ids = batch.column(0)
            for i, j, data, firsts in text_slices(batch.column(1), 4 << 20):
                s = Slice(data, firsts, special=strings)
                index, (lens, flat) = s.coded(model_codec(path))
                ids, before = gathered(index, lens, flat)
                cut = before[np.append(s.cuts, len(s.starts))]
                n = np.diff(cut) + 1
                ids = np.insert(ids.astype(kind), cut[1:], end_id)
                begin = total + np.cumsum(n) - n
                state[3].write_batch(pa.RecordBatch.from_arrays([doc_ids.slice(i, j - i).cast(pa.int64()), pa.array(begin), pa.array(n)], schema=doc_schema))
                total += len(ids)
                rest.append(ids)
                if sum(map(len, rest)) >= block:
                    flat = np.concatenate(rest)
                    k = len(flat) // block * block
                    for p in range(0, k, block):
                        put(state[2], flat[p : p + block], block)
                    rest = [flat[k:]]
            own_ids = [x for x in (doc_ids[0].as_py(), doc_ids[-1].as_py()) if x is not None]
            lo, hi = min([x for x in (lo, *own_ids) if x is not None], default=None), max([x for x in (hi, *own_ids) if x is not None], default=None)
        if state is not None:
            flat = np.concatenate(rest)
            if len(flat):
                put(state[2], flat, len(flat))
            for x in (state[2], state[3], state[0], state[1]):
                x.close()
            system.move(ids_at + own, ids_at)
            system.move(docs_at + own, docs_at)
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "lo": pa.array([lo], pa.int64()), "hi": pa.array([hi], pa.int64()), "name": [name], "n_tokens": [total]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    done = sorted((r.asDict() for r in rows.mapInArrow(write, "part int, lo long, hi long, name string, n_tokens long").collect()), key=lambda r: r["part"])
    at = 0
    for r in done:
        r["start"], at = at, at + r["n_tokens"]
    return done


def read_packed(spark, parts: list[dict]) -> DataFrame:
    """One row per document out of packed_files(): where its ids start among all, how many they are, and their checksum, each computed from the files."""

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = Packed(f"{name}.ids.arrow")
                system, path = files_of(f"{name}.docs.arrow")
                with system.open_input_file(path) as f, pa.ipc.open_stream(f) as r:
                    for b in r:
                        starts, ns = b.column(1).to_numpy(), b.column(2).to_numpy()
                        crc = [zlib.crc32(ids.span(int(a), int(n)).astype("<u4").tobytes()) for a, n in zip(starts, ns, strict=True)]
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts + base), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(r["name"], r["start"]) for r in parts]
    files = spark.createDataFrame(rows, "name string, start long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed(docs: DataFrame, path: str, end_id: int = 2, to: str | None = None, length: int = 1024) -> DataFrame:
    """packed_files() into a new folder of the shared place (or to), then read_packed(): the rows come from the files."""
    spark = docs.sparkSession
    return read_packed(spark, packed_files(docs, path, end_id, qualified(spark, to or new_path(spark, "ids")), length))


# ---------------------------------------------------------------- operator 8


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per document its UTF-8 bytes, its tokens by a byte-level .json vocabulary, and whether these are over limit.

    Null texts count as empty: 0 bytes, 0 tokens. Special strings in texts are one token each. Very long texts are whole: they
    go through in slices. Repeated doc_ids, and equal rows, stay separate rows; a null doc_id stays null; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    modest_batches(docs.sparkSession)
    strings = [x.encode() for x in merge_file(path)[2]]

    def count(batches):
        codec = Codec(lambda pieces: [int(n).to_bytes(4, "little") for n in merger(path).counts(pieces)])
        for batch in batches:
            for i, j, data, firsts in text_slices(batch.column(1), 4 << 20):
                s = Slice(data, firsts, special=strings)
                index, (_, n) = s.coded(codec)
                before = np.zeros(len(index) + 1, np.int64)
                np.cumsum(n[index] if len(index) else [], out=before[1:])
                tokens = np.diff(before[np.append(s.cuts, len(s.starts))])
                size = np.diff(np.append(firsts, len(data)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
