"""A hashed maximum-entropy language model (operator 3).

Every token has a class: the most frequent ones share classes of WIDTH by rank, each with a place of its own; all others are in a class for
each power of two of their counts, or, where their counts aren't sent to tasks, in the class of the tail, and their place there is a hash. The probability of a token is
that of its class times that of its place within it, each a softmax over summed weights of hashed features of the words that stand before,
whichever words these are: the last one (a bigram) and the one before it (a skip feature). Where words share a place, each has its
share of their counts. Tasks make gradient steps on what they read, and their changes are averaged.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import forget, modest_batches, most_frequent, written
from revlens.llm.pretoken import lower_bytes, text_slices, words

CLASSES, WIDTH = 16, 32
FREQUENT = CLASSES * WIDTH
#: What stands before a text, in place of a word's hash.
START = np.uint64(1)
#: Words whose counts go along with the code, at most (26 bytes each); counts of all others meet their words in a join.
SENT = 300_000
#: Rows of weights for classes: a power of two from a sixteenth of the vocabulary on, within these bounds; for places twice as many.
LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 15
#: Tokens of a gradient step.
STEP = 1 << 12
HASHES = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
#: The bias of what never occurs.
NEVER = -40.0


def mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for k, p in enumerate(parts):
        h = (h ^ (p.astype(np.uint64) + np.uint64(k + 1))) * HASHES[k]
        h ^= h >> np.uint64(29)
    return h


def hashed(*parts: np.ndarray, rows: int) -> np.ndarray:
    """A row for each combination."""
    return (mixed(*parts) & np.uint64(rows - 1)).astype(np.int64)


def word_hash(word: bytes) -> int:
    """The same as xxhash64(word) in Spark, but unsigned."""
    return xxhash.xxh64_intdigest(word, 42)


#: Seed by which a word's second hash is that of xxhash64(1, word) in Spark.
SECOND = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)


class Counts:
    """Counts of training tokens: of all, and of those sent along, by two hashes of the word, which together tell words apart.

    top: (hash, second hash, count) arrays; tail: (words, sum of counts) of all other words by place.
    """

    def __init__(self, n: int, v: int, ends: int, top: tuple[np.ndarray, np.ndarray, np.ndarray], tail: np.ndarray):
        self.n, self.v, self.ends = n, v, ends
        key, check, c = top[0].view(np.uint64), top[1].view(np.uint64), top[2]
        own = FREQUENT - 1 if ends else FREQUENT
        order = np.lexsort((key, -c))
        rank = np.empty(len(c), np.int64)
        rank[order] = np.arange(len(c))
        rank += (rank < own) & (c < ends) & bool(ends)  # the end's rank comes before those of fewer counts
        band = np.log2(np.maximum(c, 1)).astype(np.int64)
        rare = np.ones(len(c), bool)
        rare[order[:own]] = False
        bands = np.unique(band[rare])
        self.classes = CLASSES + len(bands) + 1
        self.tail = self.classes - 1
        cls = np.where(rare, CLASSES + np.searchsorted(bands, band), rank // WIDTH)
        pos = np.where(rare, (key % np.uint64(WIDTH)).astype(np.int64), rank % WIDTH)
        self.end = divmod(int((c[~rare] >= ends).sum()), WIDTH) if ends else (self.tail, 0)
        self.mass = np.zeros((self.classes, WIDTH))
        np.add.at(self.mass, (cls, pos), np.where(rare, c + 0.1, c))
        if ends:
            self.mass[self.end] = ends
        self.mass[self.tail] = tail[:, 1] + 0.1 * (tail[:, 0] + 1)  # and an unknown word
        by = np.argsort(key)
        self.key, self.check, self.of = key[by], check[by], (cls[by].astype(np.uint8), pos[by].astype(np.uint8), c[by])

    def found(self, distinct: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(hash, [class, place, count or -1]) of distinct words."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, distinct, repeat(42)), np.uint64, len(distinct))
        at = np.minimum(np.searchsorted(self.key, h), max(len(self.key) - 1, 0))
        if not len(self.key):
            known = np.zeros(len(h), bool)
        else:
            known = self.key[at] == h
            known &= self.check[at] == np.fromiter(map(xxhash.xxh64_intdigest, distinct, repeat(SECOND)), np.uint64, len(distinct))
        out = []
        for values, missing in zip(self.of, (self.tail, (h % np.uint64(WIDTH)).astype(np.int64), -1), strict=True):
            out.append(np.where(known, values[at].astype(np.int64) if len(values) else 0, missing))
        return h, out

    def base(self, c):
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


class Model:
    """Weights of both softmaxes; their biases begin with the tokens' frequencies."""

    def __init__(self, counts: Counts, rows: int | None = None):
        if rows is None:
            rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << max(0, counts.v // 16 - 1).bit_length()))
        self.first = np.zeros((rows, counts.classes), np.float32)
        self.second = np.zeros((2 * rows, WIDTH), np.float32)
        with np.errstate(divide="ignore"):
            mass = counts.mass.sum(1, keepdims=True)
            self.biases = np.maximum(np.log(counts.mass / np.maximum(mass, 1e-9)), NEVER).astype(np.float32)
            self.class_bias = np.maximum(np.log(mass[:, 0] / mass.sum()), NEVER).astype(np.float32)

    def rows_1(self, w1, w2):
        n, zero = len(self.first), np.zeros_like(w1)
        return np.stack([hashed(zero, w1, rows=n), hashed(zero + np.uint64(1), w2, rows=n)], 1)

    def rows_2(self, c, w1, w2):
        n, zero = len(self.second), np.zeros_like(w1)
        return np.stack([hashed(c, zero, w1, rows=n), hashed(c, zero + np.uint64(1), w2, rows=n)], 1)

    @staticmethod
    def shares(bias, weights, rows, step: int = 1 << 13):
        """The softmax for each row of features, computed a part at a time."""
        out = np.empty((len(rows), weights.shape[1]), np.float32)
        one = np.ones(weights.shape[1], np.float32)
        for p in range(0, len(rows), step):
            r = rows[p : p + step]
            x = np.take(weights, r[:, 0], axis=0, mode="clip")
            for k in range(1, r.shape[1]):
                x += np.take(weights, r[:, k], axis=0, mode="clip")
            x += bias if bias.ndim == 1 else bias[p : p + step]
            np.minimum(x, 60, out=x)  # far above what weights come to; no overflow
            np.exp(x, out=x)
            np.divide(x, (x @ one)[:, None], out=out[p : p + step])
        return out

    @staticmethod
    def contexts(w1, w2):
        """(the different contexts, index of each token's among them)."""
        _, first, at = np.unique(mixed(w1, w2), return_index=True, return_inverse=True)
        return w1[first], w2[first], at

    def of_tokens(self, cls, pos, w1, w2) -> np.ndarray:
        """log10 of the probability of each token's class and place. Each context is computed once."""
        c1, c2, at = self.contexts(w1, w2)
        out = self.shares(self.class_bias, self.first, self.rows_1(c1, c2))[at, cls].astype(np.float64)
        pairs, to = np.unique(at * len(self.class_bias) + cls, return_inverse=True)
        x, k = np.divmod(pairs, len(self.class_bias))
        out *= self.shares(self.biases[k], self.second, self.rows_2(k, c1[x], c2[x]))[to, pos]
        return np.log10(np.maximum(out, 1e-300))


def run_sums(rows: np.ndarray, order: np.ndarray, at: np.ndarray, short: int = 6) -> np.ndarray:
    """The sums of runs of rows: run i is rows[order[at[i]:at[i + 1]]]. Most runs are short: their rows are added one place after another, all runs at once; what is left of long ones is summed run by run."""
    size = np.diff(np.append(at, len(order)))
    out = np.take(rows, order[at], axis=0, mode="clip")
    some = np.flatnonzero(size > 1)
    for j in range(1, short):
        if not len(some):
            return out
        out[some] += np.take(rows, order[at[some] + j], axis=0, mode="clip")
        some = some[size[some] > j + 1]
    if len(some):
        left = size[some] - short
        first = np.cumsum(left) - left
        place = np.repeat(at[some] + short - first, left) + np.arange(left.sum())
        out[some] += np.add.reduceat(np.take(rows, order[place], axis=0, mode="clip"), first, axis=0)
    return out


class Learner:
    """Gradient steps with a rate for each row of weights (AdaGrad)."""

    def __init__(self, model: Model, rate: float):
        self.m, self.rate = model, rate
        self.g1, self.g2 = np.full(len(model.first), 1e-3, np.float32), np.full(len(model.second), 1e-3, np.float32)

    def move(self, weights, squares, rows, gradient):
        for k in range(rows.shape[1]):
            r = rows[:, k]
            order = np.argsort(r.astype(np.uint16) if len(weights) <= 1 << 16 else r, kind="stable")
            r = r[order]
            at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            g = run_sums(gradient, order, at)
            r = r[at]
            square = np.take(squares, r) + np.einsum("ij,ij->i", g, g)
            squares[r] = square
            g *= (self.rate / np.sqrt(square))[:, None]
            g += np.take(weights, r, axis=0, mode="clip")
            weights[r] = g

    def learn(self, cls, pos, w1, w2):
        m = self.m
        n = len(m.class_bias)
        c1, c2, at = m.contexts(w1, w2)
        rows = m.rows_1(c1, c2)
        much = np.bincount(at, minlength=len(c1)).astype(np.float32)
        p = m.shares(m.class_bias, m.first, rows)
        p *= -much[:, None]
        np.add.at(p, (at, cls), np.float32(1))
        self.move(m.first, self.g1, rows, p)
        pairs, to, much = np.unique(at * n + cls, return_inverse=True, return_counts=True)
        x, k = np.divmod(pairs, n)
        rows = m.rows_2(k, c1[x], c2[x])
        p = m.shares(m.biases[k], m.second, rows)
        p *= -much.astype(np.float32)[:, None]
        np.add.at(p, (to, pos), np.float32(1))
        self.move(m.second, self.g2, rows, p)


def tokens(counts: Counts, data, firsts):
    """(class and place of each token, ends of texts among them; hashes of the words before and before those; first token of each text; distinct words, their classes, places and
    counts (-1: not sent), index of each word among them, first word of each text)."""
    found, cuts = words(lower_bytes(data), firsts)
    enc = found.dictionary_encode()
    distinct = enc.dictionary.to_pylist()
    index = enc.indices.to_numpy() if len(found) else np.zeros(0, np.int64)
    h, of = counts.found(distinct)
    cls, pos = (np.insert(of[k][index], cuts[1:], counts.end[k]) for k in (0, 1))
    h = np.insert(h[index], cuts[1:], START)
    begin = cuts[:-1] + np.arange(len(cuts) - 1)
    w1 = np.append(START, h[:-1])
    w1[begin] = START
    w2 = np.append(START, w1[:-1])
    w2[begin] = START
    return (cls, pos, w1, w2), begin, distinct, of, index, cuts


def counted(docs: DataFrame) -> DataFrame:
    """(word, c) over training texts (doc_id, text, train)."""

    def run(batches):
        for batch in batches:
            for _, _, data, firsts in text_slices(batch.column(0)):
                found, _ = words(lower_bytes(data), firsts)
                enc = found.dictionary_encode()
                n = np.bincount(enc.indices.to_numpy(), minlength=len(enc.dictionary)) if len(found) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([enc.dictionary.cast(pa.string()), pa.array(n)], ["word", "c"])

    rows = docs.where("train").select("text").mapInArrow(run, "word string, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def trained(docs: DataFrame, counts: Counts, rounds: int = 1, rate: float = 1.0) -> Model:
    """The model after rounds passes over the training texts. In a pass each task makes gradient steps from the weights so far; then the
    changes of each row are averaged over the tasks that changed it. What comes to the driver has the size of the model."""
    model = Model(counts)
    block = 256

    for _ in range(rounds):

        def run(batches, model=model):
            learner = Learner(model, rate)
            first, second = model.first.copy(), model.second.copy()
            for batch in batches:
                for _, _, data, firsts in text_slices(batch.column(0), 3 << 20):
                    got = tokens(counts, data, firsts)[0]
                    for p in range(0, len(got[0]), STEP):
                        learner.learn(*(x[p : p + STEP] for x in got))
            for t, (now, before) in enumerate(((model.first, first), (model.second, second))):
                d = now - before
                for p in range(0, len(d), 16 * block):
                    some = [(k, d[k : k + block]) for k in range(p, min(p + 16 * block, len(d)), block)]
                    some = [(k, x.tobytes()) for k, x in some if x.any()]
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(some), pa.int32()), pa.array([k for k, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], ["t", "k", "d"])

        def mean(key, table):
            n, total = 0, 0.0
            width = counts.classes if key[0].as_py() == 0 else WIDTH
            for d in table.column("d"):
                x = np.frombuffer(d.as_buffer(), np.float32).reshape(-1, width).astype(np.float64)
                n = n + (x != 0).any(1, keepdims=True)
                total = total + x
            out = (total / np.maximum(n, 1)).astype(np.float32)
            return pa.table({"t": table.column("t")[:1], "k": table.column("k")[:1], "d": pa.array([out.tobytes()], pa.binary())})

        changes = docs.where("train").select("text").mapInArrow(run, "t int, k int, d binary").groupBy("t", "k").applyInArrow(mean, "t int, k int, d binary")
        changes = written(changes, "weights")
        for r in changes.toLocalIterator():
            to = model.first if r["t"] == 0 else model.second
            x = np.frombuffer(r["d"], np.float32).reshape(-1, to.shape[1])
            to[r["k"] : r["k"] + len(x)] += x
        forget(changes)
    return model


def prepared(docs: DataFrame, folds: int) -> DataFrame:
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(left != 0, F.lit(False)).alias("train"), F.coalesce(left == 0, F.lit(False)).alias("held_out"))


def lm_scores(docs: DataFrame, folds: int = 10, rounds: int = 1, sent: int = SENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    Rows whose crc32(doc_id) mod folds is 0 are held out; the others are learnt from. Null texts count as empty and have
    just their end. A row without a doc_id is scored, neither held out nor learnt from. Repeated doc_ids stay separate rows. Other
    columns are ignored. Without a training text all counts are 0. An empty table gives an empty result. Very long texts are scored whole.
    """
    modest_batches(docs.sparkSession)
    docs = prepared(docs, folds)
    table = written(counted(docs), "counts")
    total = table.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = docs.where("train").count()
    sent_ = most_frequent(table, "word", "c", sent)
    top = table.where(sent_).select(F.xxhash64("word").alias("h"), F.xxhash64(F.lit(1), "word").alias("h2"), "c").toPandas()  # three numbers for each of about `sent` words
    top = tuple(top[c].to_numpy(np.int64) for c in ("h", "h2", "c"))
    tail = np.zeros((WIDTH, 2))
    for r in table.where(~sent_).groupBy((F.xxhash64("word").bitwiseAND(F.lit(WIDTH - 1))).alias("p")).agg(F.count("*").alias("k"), F.sum("c").alias("c")).collect():
        tail[r["p"]] = r["k"], r["c"]
    counts = Counts((total["n"] or 0) + ends, total["v"] + (ends > 0), ends, top, tail)
    model = trained(docs, counts, rounds) if ends else Model(counts)
    whole = len(top[0]) == total["v"]  # every known word was sent
    schema = "row long, doc_id long, held_out boolean, word string, k long, n_tokens long, n_known long, base double, score double"

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        end_known = int(counts.ends > 0)
        for batch in batches:
            for i, j, data, firsts in text_slices(batch.column(1)):
                got, begin, distinct, (cls, pos, c), index, cuts = tokens(counts, data, firsts)
                score = np.concatenate([model.of_tokens(*(x[p : p + 4 * STEP] for x in got)) for p in range(0, len(got[0]), 4 * STEP)])
                score = np.add.reduceat(score, begin)
                if whole:
                    c = np.maximum(c, 0)
                sure = c >= 0
                share = np.where(cls < CLASSES, 0.0, np.where(sure, np.log10(np.maximum(c, 0) + 0.1), 0.0) - np.log10(np.where(cls < CLASSES, 1.0, counts.mass[cls, pos])))
                per = np.stack([np.where(sure, counts.base(np.maximum(c, 0)), 0.0), share, c > 0])
                run_ = np.zeros((3, len(index) + 1))
                if len(index):
                    np.cumsum(per[:, index], axis=1, out=run_[:, 1:])
                base, extra, known = run_[:, cuts[1:]] - run_[:, cuts[:-1]]
                n = np.diff(cuts) + 1
                end_other = 0.0 if counts.ends else float(np.log10(0.1 / counts.mass[counts.end]))
                m = j - i
                rows = np.arange(row, row + m)
                none = pa.nulls(m, pa.string())
                cols = [pa.array(rows), batch.column(0).slice(i, m), batch.column(2).slice(i, m), none, pa.array(np.zeros(m, np.int64)), pa.array(n), pa.array(known.astype(np.int64) + end_known), pa.array(base + counts.base(counts.ends)), pa.array(score + extra + end_other)]
                names = ["row", "doc_id", "held_out", "word", "k", "n_tokens", "n_known", "base", "score"]
                yield pa.RecordBatch.from_arrays(cols, names)
                if not sure.all():
                    on = np.flatnonzero(~sure[index])
                    of = np.repeat(np.arange(m), np.diff(cuts))[on]
                    pair, k = np.unique(of * len(distinct) + index[on], return_counts=True)
                    of, w = pair // len(distinct), pair % len(distinct)
                    z = pa.array(np.zeros(len(pair), np.int64))
                    zf = pa.array(np.zeros(len(pair)))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[of]), pa.nulls(len(pair), pa.int64()), pa.nulls(len(pair), pa.bool_()), pa.array([distinct[x].decode() for x in w.tolist()], pa.string()), pa.array(k), z, z, zf, zf], names)
                row += m

    rows = docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)
    if not whole:
        # words that weren't sent are rare, so no key of this join is hot; texts' own rows get keys of their own
        rows = rows.withColumn("word", F.coalesce("word", F.concat(F.lit(" "), F.col("row").cast("string"))))
        rows = rows.join(table, "word", "left")
        found, k = F.coalesce("c", F.lit(0)), F.col("k")
        base = F.log10((found + 0.1) / F.lit(counts.n + 0.1 * (counts.v + 1)))
        other = F.log10(found + 0.1)  # the rest of its share has been counted
        rows = rows.withColumn("base", F.col("base") + k * base).withColumn("score", F.col("score") + k * other).withColumn("n_known", F.col("n_known") + F.when(found > 0, k).otherwise(0)).withColumn("n_tokens", F.col("n_tokens"))
        rows = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
