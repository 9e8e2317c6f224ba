"""Near-duplicate vectors by iterative quantisation (operator 5).

Rotations learnt on a bounded sample make balanced binary codes; codes are cut into substrings, each with a
table (so every pair whose codes differ in fewer bits than there are tables meets for sure); as many rotations, with tables of their own, are made as it takes
to miss few pairs right at the threshold. Those of a bucket whose whole codes are near are compared by their original values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import components, forget, modest_batches, written

SAMPLE = 20_000
#: Rows of a bucket that one task compares at once; larger buckets are dealt out by pairs of blocks.
BUCKET = 4_000
#: Share of the pairs right at the least cosine that may meet in no table, as far as bits differ independently.
MISSED = 0.01


class Quantiser:
    """Centring, principal axes and the learnt rotation; code() gives up to 64 bits a vector."""

    def __init__(self, sample: np.ndarray, bits: int = 64, steps: int = 30, seed: int = 7):
        d = sample.shape[1]
        self.bits = bits = min(bits, d)
        self.mean = sample.mean(0)
        x = sample - self.mean
        _, axes = np.linalg.eigh(x.T @ x / max(len(x), 1))
        axes = axes[:, ::-1][:, :bits]
        v = x @ axes
        r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
        for _ in range(steps):  # nearest codes for the rotation, then the nearest rotation for the codes
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.to = axes @ r

    def code(self, unit: np.ndarray) -> np.ndarray:
        on = (unit - self.mean) @ self.to >= 0
        out = np.zeros(len(unit), np.uint64)
        for k in range(self.bits):
            out |= on[:, k].astype(np.uint64) << np.uint64(k)
        return out


def cuts(n: int, bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each substring: of about log2(n) - 6 bits, at least 8 where the code allows, so that a bucket has some tens of rows."""
    tables = max(1, bits // max(8, int(np.log2(max(n, 2))) - 6))
    edge = [bits * k // tables for k in range(tables + 1)]
    return list(zip(edge, np.diff(edge).tolist()))


def differing(least: float) -> float:
    """The share of bits that differ right at the least cosine."""
    return float(np.arccos(np.clip(least, -1, 1))) / np.pi


def rotations(parts: list[tuple[int, int]], least: float) -> int:
    """How many rotations it takes until all but MISSED of the pairs of cosine least agree in some substring."""
    miss = float(np.prod([1 - (1 - differing(least)) ** n for _, n in parts]))
    return 1 if miss <= MISSED else int(np.ceil(np.log(MISSED) / np.log(miss)))


def reach(bits: int, least: float) -> int:
    """Bits of a code in which pairs of cosine least differ at most: four deviations over the mean."""
    p = differing(least)
    return int(np.ceil(bits * p + 4 * np.sqrt(bits * p * (1 - p))))


def unit_rows(flat: np.ndarray, d: int) -> np.ndarray:
    x = flat.reshape(-1, d).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, cid, vec) of each row: cid is a digest of the values, null for a vector that links with nothing."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            offsets = column.offsets.to_numpy().astype(np.int64)
            x = column.values.cast(pa.float64())
            x = x.fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0  # -0.0 equals 0.0
            wrong, some = (np.append(0, np.cumsum(v)) for v in (~np.isfinite(x), x != 0))
            a, b = offsets[:-1], offsets[1:]
            ok = (wrong[b] == wrong[a]) & (some[b] > some[a])
            if column.null_count:
                ok &= column.is_valid().to_numpy(zero_copy_only=False)
            raw = [x[p:q].tobytes() if good else None for p, q, good in zip(a.tolist(), b.tolist(), ok.tolist(), strict=True)]
            keep = [xxhash.xxh3_64_intdigest(r) - (1 << 63) if r is not None else None for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keep, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "cid", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, cid long, vec binary")


def members(classes: DataFrame, quantisers: dict[int, list[Quantiser]], parts: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """(bucket, d, t, cid, code) of classes (cid, vec): a row in the bucket of each substring t of each vector of length d; code has the codes of all rotations. The vectors stay behind."""

    def run(batches):
        for batch in batches:
            cid, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            size = np.array([len(x) >> 3 for x in raw], np.int64)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = unit_rows(np.frombuffer(b"".join([raw[i] for i in at]), np.float64), d)
                codes = np.stack([q.code(x) for q in quantisers[d]], 1)
                code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * codes.shape[1]), len(at), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
                for t, (r, (a, n)) in enumerate((r, part) for r in range(len(quantisers[d])) for part in parts[d]):
                    sub = (codes[:, r] >> np.uint64(a)) & np.uint64((1 << n) - 1)
                    base = np.uint64((d * 4096 + t) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                    yield pa.RecordBatch.from_arrays([pa.array((base + sub).view(np.int64)), pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), t, np.int32)), pa.array(cid[at]), code], ["bucket", "d", "t", "cid", "code"])

    return classes.mapInArrow(run, "bucket long, d int, t int, cid long, code binary")


def grouped(batches, key: tuple[int, ...]):
    """The rows of each run of equal keys (columns of numbers), as one record batch; the rows are sorted by key."""
    held, now = [], None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy() for k in key]
        new = np.zeros(len(batch), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        edge = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for i, j in zip(edge, edge[1:]):
            this = tuple(int(c[i]) for c in cols)
            if this != now and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = this
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def sides_of(own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(left, right, whether they are the same) rows to compare: all of one block, or those of two blocks across."""
    every = np.arange(len(own))
    low = own == own.min()
    return [(every, every, True)] if low.all() else [(every[~low], every[low], False)]


def counted_here(a, b, cid, code, t: int, parts) -> np.ndarray:
    """Which pairs of rows count in table t: distinct ones that agree in no earlier substring."""
    differ = code[a] ^ code[b]
    first = cid[a] != cid[b]
    for k in range(t):
        r, (start, n) = k // len(parts), parts[k % len(parts)]
        first &= (differ[:, r] >> np.uint64(start)) & np.uint64((1 << n) - 1) != 0
    return first


def near_rows(cid, code, own, t: int, parts, most: int, step: int = 512) -> np.ndarray:
    """Rows of a bucket that have a partner whose code differs in at most `most` bits and that counts here."""
    hit = np.zeros(len(cid), bool)
    r = t // len(parts)
    for left, right, same in sides_of(own):
        for p in range(0, len(left), step):
            some = left[p : p + step]
            a, b = np.nonzero(np.bitwise_count(code[some, r][:, None] ^ code[right, r][None, :]) <= most)
            a, b = some[a], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            ok = counted_here(a, b, cid, code, t, parts)
            hit[a[ok]] = hit[b[ok]] = True
    return np.flatnonzero(hit)


def compared(cid, w, code, x, own, t: int, parts, least: float, step: int = 512):
    """Of one bucket, or of two blocks of it: (cid, links) of each vector with links that are counted here, and edges that join linked ones. A pair counts in the first table where it meets."""
    total = np.zeros(len(cid), np.int64)
    pairs_a, pairs_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for left, right, same in sides_of(own):
        y = x[right].T
        for p in range(0, len(left), step):
            a, b = np.nonzero(x[left[p : p + step]] @ y >= least)
            a, b = left[a + p], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            first = counted_here(a, b, cid, code, t, parts)
            a, b = a[first], b[first]
            np.add.at(total, a, w[b])
            np.add.at(total, b, w[a])
            pairs_a.append(a)
            pairs_b.append(b)
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    label = np.arange(len(cid))
    while True:  # smallest label along links
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (old == label).all():
            break
    hung = np.flatnonzero(label != np.arange(len(cid)))
    some = np.flatnonzero(total)
    return cid[some], total[some], cid[hung], cid[label[hung]]


def dealt(rows: DataFrame, bucket: int) -> DataFrame:
    """rows with own (block of a row in a hot bucket) and cell: a hot bucket is dealt out by pairs of blocks of about half of bucket."""
    hot = written(rows.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket", F.ceil(F.col("count") / (bucket // 2)).cast("int").alias("blocks")), "hot")
    own = F.coalesce(F.pmod(F.xxhash64("cid"), F.col("blocks")), F.lit(0)).cast("int")
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o)))
    met = rows.join(hot, "bucket", "left") if not hot.isEmpty() else rows.withColumn("blocks", F.lit(None).cast("int"))
    # a pair of one block meets in each cell of that block: it counts in the cell of the block with itself only
    return met.select(*rows.columns, own.alias("own"), F.explode(cells).alias("cell"))


def near_duplicates(vectors: DataFrame, least: float = 0.9, sample: int = SAMPLE, bucket: int = BUCKET, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding): links join rows of cosine at least least.

    Equal vectors link without a search. Null vectors, zero ones and those with null or non-finite values link with nothing, and
    vectors of different lengths don't link. A row without a vec_id counts for nobody and has null for its component and kept.
    Rows that share a vec_id stay separate rows. Other columns are ignored. An empty table gives an empty result.
    The sample for the rotation is bounded (about sample vectors of each length, by hash); every vector is indexed. exact: all pairs are compared, in blocks.

    Codes alone are dealt out to the buckets; vectors go just to those where one has a partner whose code is near.
    """
    spark = vectors.sparkSession
    modest_batches(spark)
    rows = written(classes_of(vectors), "vectors")
    valid = rows.where("cid is not null and vec_id is not null")
    classes = written(valid.groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("vec").alias("vec")), "classes")
    length = (F.octet_length("vec") / 8).cast("int")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(length.alias("d")).count().withColumnRenamed("count", "n").collect()}
    part = F.create_map(*(F.lit(v) for d, n in sizes.items() for v in (d, min(1.0, sample / n)))) if sizes else None
    taken: dict[int, list[bytes]] = {}
    if sizes:  # about `sample` vectors of each length
        for r in classes.where(F.pmod(F.xxhash64(F.lit(3), "cid"), F.lit(1 << 30)) < part[length] * (1 << 30)).select("vec").collect():
            taken.setdefault(len(r["vec"]) >> 3, []).append(bytes(r["vec"]))
    samples = {d: unit_rows(np.frombuffer(b"".join(taken[d]), np.float64), d) if d in taken else np.eye(d) for d in sizes}
    parts = {d: [(0, 0)] if exact else cuts(n, min(64, d)) for d, n in sizes.items()}
    quantisers = {d: [Quantiser(samples[d], seed=7 + r) for r in range(1 if exact else rotations(parts[d], least))] for d in sizes}
    most = {d: 64 if exact else reach(min(64, d), least) for d in sizes}
    names = ["bucket", "cell", "d", "t", "cid", "code", "own"]
    met = dealt(members(classes.select("cid", "vec"), quantisers, parts), bucket).select(*names)
    met = met.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")

    def columns(group):
        cid, own = group.column("cid").to_numpy(), group.column("own").to_numpy()
        code = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint64).reshape(len(cid), -1)
        return group.column("d")[0].as_py(), group.column("t")[0].as_py(), cid, code, own

    def near(batches):
        held, size = [], 0
        for group in grouped(batches, (0, 1)):
            if len(group) < 2:
                continue
            d, t, cid, code, own = columns(group)
            some = near_rows(cid, code, own, t, parts[d], most[d])
            if len(some):
                held.append(group.take(pa.array(some)))
                size += len(some)
            if size > 20_000:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    kept = written(met.mapInArrow(near, "bucket long, cell int, d int, t int, cid long, code binary, own int"), "near")
    full = kept.join(classes.select("cid", "w", "vec"), "cid").select(*names, "w", "vec").repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")

    def run(batches):
        for group in grouped(batches, (0, 1)):
            d, t, cid, code, own = columns(group)
            x = unit_rows(np.frombuffer(b"".join(group.column("vec").to_pylist()), np.float64), d)
            ids, n, a, b = compared(cid, group.column("w").to_numpy(), code, x, own, t, parts[d], least)
            if len(ids) or len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)])), pa.array([None] * len(ids) + b.tolist(), pa.int64())], ["a", "n", "b"])

    found = written(full.mapInArrow(run, "a long, n long, b long"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    comp = components(found.where("b is not null").select("a", "b"))
    named = classes.select("cid", "rep", "w").join(comp.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    named = written(named.select("cid", "rep", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("comp", "cid").alias("comp")), "named")
    forget(classes, kept, found, comp)
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by = named.join(smallest, "comp").select("cid", "n_links", "component_id")
    out = rows.select("vec_id", "cid").join(by, "cid", "left")
    linked = F.col("cid").isNotNull() & F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
