"""Toxicity of texts whose words may be disguised (operator 9).

Words that look disguised (digits or signs among letters, a letter three times, letters spaced out) are decoded
through a noisy channel: each seen character opens a small lattice of true characters or nothing, and a Viterbi
search over it maximises channel times character language model. Learnt word and word-beginning weights then score the
restored text.
"""

from __future__ import annotations

import math
import re
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import lean, modest_batches
from revlens.llm.pretoken import LETTER, classes, text_slices, words

#: What each sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = frozenset(".-_*~ '")
KEEP, SWAP, REPEAT, SKIP, STAY, BREAK = math.log(0.9), math.log(0.08), math.log(0.05), math.log(0.3), math.log(0.01), math.log(0.2)
#: Symbols of the character model: 0 the border of words and all that is no letter, then a to z, the letters of Latin-1, and one for all other letters.
LATIN = [*range(97, 123), *(c for c in range(0xDF, 0x100) if chr(c).isalpha())]
SYMBOLS = len(LATIN) + 2


@cache
def symbols() -> np.ndarray:
    """The symbol of each code point."""
    out = np.where(classes() == LETTER, SYMBOLS - 1, 0).astype(np.uint8)
    for i, c in enumerate(LATIN):
        out[c] = i + 1
    for c in [*range(65, 91), *range(0xC0, 0xDF)]:
        out[c] = out[ord(chr(c).lower())]
    return out


_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_THRICE = re.compile(r"(\w)\1\1")
_LETTER = re.compile(r"[^\W\d_]")


class CharModel:
    """Trigrams of characters within words, backed off linearly, from counts of (symbol, symbol, symbol)."""

    def __init__(self, counts: np.ndarray):
        tri = counts.astype(np.float64)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + SYMBOLS)
        p2 = (bi + 3 * p1) / (bi.sum(1, keepdims=True) + 3)
        p3 = (tri + 3 * p2) / (tri.sum(2, keepdims=True) + 3)
        self.log = np.log(p3).astype(np.float32)

    def decode(self, seen: str, best: int = 4, spaced: bool = False) -> list[str]:
        """The best true words for a seen one; its own letters are always among the readings. spaced: a blank of the seen may end a word.

        A state is the last two symbols and the last character; each keeps its best way there, as a chain of characters. What may stand
        at a place is little, so all states are kept, and the time is linear in the length.
        """
        log, sym = self.log, symbols()
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for c in seen:
            nxt: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

            def reach(key, v, way, nxt=nxt):
                if key not in nxt or nxt[key][0] < v:
                    nxt[key] = (v, way)

            outs = [(c, KEEP)] if sym[ord(c)] else []
            outs += [(x, SWAP) for x in LEET.get(c, "")]
            drop = SKIP if c in SEPARATORS or not (sym[ord(c)] or c in LEET) else None
            for (a, b, last), (score, way) in states.items():
                for x, cost in outs:
                    s = int(sym[ord(x)])
                    reach((b, s, x), score + cost + float(log[a, b, s]), (way, x))
                if last and (c == last or last in LEET.get(c, "")):  # a repeated one
                    reach((a, b, last), score + REPEAT, way)
                if spaced and c == " " and b:
                    reach((0, 0, ""), score + BREAK + float(log[a, b, 0]), (way, " "))
                if drop is not None:
                    reach((a, b, last), score + drop, way)
                if not outs and drop is None:
                    nxt[(a, b, last)] = (score + STAY, way)
            states = nxt
        done = sorted(((v + float(log[a, b, 0]), way) for (a, b, _), (v, way) in states.items() if way), key=lambda x: -x[0])
        return list(dict.fromkeys(written_out(way) for _, way in done))[:best]

    def readings(self, token: str) -> list[str]:
        """A lower-case token's words: itself without its edges' signs and, where it looks disguised, what it decodes to."""
        bare = _EDGE.sub("", token)
        if _PLAIN.fullmatch(bare) and not _THRICE.search(bare):
            if len(bare) == len(token) or not any(c in LEET for c in token):
                return [bare]
        if not _LETTER.search(token):
            return [bare] if bare else []
        return list(dict.fromkeys([*([bare] if bare else []), *self.decode(token)]))


def written_out(way: tuple | None) -> str:
    out = []
    while way is not None:
        way, x = way
        out.append(x)
    return "".join(reversed(out)).strip()


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigrams of symbols over all texts: at most SYMBOLS**3 rows come to the driver, however many texts there are."""

    def count(batches):
        total, sym = np.zeros(SYMBOLS**3, np.int64), symbols()
        for batch in batches:
            for _, _, data, _ in text_slices(batch.column(0)):
                s = np.zeros(3 + len(data), np.int32)  # of texts side by side: a border between them
                got = sym[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
                s = s[: len(got) + 3]
                s[2:-1] = got
                # between words the context starts anew
                a, b, c = s[:-2].copy(), s[1:-1], s[2:]
                a[b == 0] = 0
                code = (a * SYMBOLS + b) * SYMBOLS + c
                total += np.bincount(code[(b > 0) | (c > 0)], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(lean(count), "code int, n long")
    got = rows.groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def token_table(data: np.ndarray, firsts: np.ndarray, model: CharModel):
    """(index of each token among distinct ones, distinct tokens, first token of each text, [(text, readings)] of spaced-out words)."""
    found, cuts = words(data, firsts)
    enc = found.dictionary_encode()
    index = enc.indices.to_numpy()
    distinct = [w.decode() for w in enc.dictionary.to_pylist()]
    single = np.fromiter((len(w) == 1 and (w.isalnum() or (w in LEET and w != "|")) for w in distinct), bool, len(distinct))
    spaced = []
    if single.any():
        on = single[index] if len(index) else np.zeros(0, bool)
        edge = np.zeros(len(on) + 1, bool)
        edge[cuts] = True
        run = np.flatnonzero(on & np.append(True, ~on[:-1] | edge[1:-1]))
        for a in run.tolist():
            b = a + 1
            while b < len(on) and on[b] and not edge[b]:
                b += 1
            if b - a >= 4:
                letters = " ".join(distinct[i] for i in index[a:b])
                spaced.append((int(np.searchsorted(cuts, a, "right")) - 1, model.decode(letters, spaced=True)))
    return index, distinct, cuts, spaced


def features(word: str) -> list[str]:
    """A word, and its beginnings of 3 to 6 letters with a mark."""
    return [word, *(word[:k] + "*" for k in (3, 4, 5, 6) if len(word) > k)]


class Scorer:
    """Weights of features, and the curve from a text's sum to a probability."""

    def __init__(self, model: CharModel, weights: dict[str, float], a: float = 1.0, b: float = -4.0):
        self.model, self.weights, self.a, self.b = model, weights, a, b
        self._known: dict[str, float] = {}

    def of_word(self, word: str) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for f in features(word)), default=0.0)

    def of_token(self, token: str) -> float:
        v = self._known.get(token)
        if v is None:
            v = max((self.of_word(w) for w in self.model.readings(token)), default=0.0)
            if len(self._known) > 200_000:
                self._known.clear()
            if len(token) <= 64:
                self._known[token] = v
        return v

    def forget(self) -> None:
        """Drops the tokens' values at the end of a task: its worker lives on in other stages."""
        self._known.clear()

    def sums(self, data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        index, distinct, cuts, spaced = token_table(data, firsts, self.model)
        w = np.fromiter(map(self.of_token, distinct), np.float64, len(distinct))
        total = np.zeros(len(index) + 1)
        np.cumsum(w[index] if len(index) else [], out=total[1:])
        out = np.diff(total[cuts])
        for i, reads in spaced:
            out[i] += max((sum(map(self.of_word, r.split())) for r in reads), default=0.0)
        return np.maximum(out, 0)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * np.log1p(sums) + self.b)))


def lowered_slices(column: pa.Array):
    """text_slices() of a column in lower case, of which just a slice is made at a time."""
    import pyarrow.compute as pc

    for i, j, *_ in text_slices(column):
        part = column.slice(i, j - i)
        for a, b, data, firsts in text_slices(pc.utf8_lower(part.fill_null("") if part.null_count else part)):
            yield i + a, i + b, data, firsts


def learn(docs: DataFrame, labels: DataFrame, most: int = 12_000, least: int = 6, sure: float = 3.0) -> Scorer:
    """Fits the scorer. The character model counts over all texts. Labels come from at most most labelled rows
    (the bound of the fit: those first by hash of doc_id) whose crc32(doc_id) mod 3 is not 1.

    A feature counts where it stands beside at least least different left neighbours in toxic texts, so that
    copies of one text don't make its words look toxic, and where clean texts hardly have it: the log of how much more often toxic texts
    have it must be sure at least. All such features are kept; their number is bounded by the labelled rows.
    Rows without a label, and labels without a text, don't count; of several labels of a doc_id the largest holds.
    """
    modest_batches(docs.sparkSession)
    model = CharModel(char_counts(docs))
    folds = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(folds != 1)
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = docs.sparkSession.createDataFrame([tuple(r) for r in picked.collect()], "doc_id long, toxic int")  # at most `most` pairs of numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic")

    def count(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for i, j, data, firsts in lowered_slices(batch.column(0)):
                index, distinct, cuts, spaced = token_table(data, firsts, model)
                if not len(index):
                    continue
                n = len(distinct)
                doc = np.repeat(np.arange(j - i), np.diff(cuts))
                bad = toxic[i:j][doc] > 0
                t = np.bincount(np.unique(doc[bad].astype(np.int64) * n + index[bad]) % n, minlength=n)
                c = np.bincount(np.unique(doc[~bad].astype(np.int64) * n + index[~bad]) % n, minlength=n)
                mark = np.fromiter((hash_64(w) for w in distinct), np.int64, n)
                left = np.append(0, mark[index[:-1]])
                left[cuts[:-1][cuts[:-1] < len(index)]] = 0
                beside = np.zeros(n, np.int64)
                np.bitwise_or.at(beside, index[bad], np.left_shift(np.int64(1), left[bad]))
                out = []
                for k, token in enumerate(distinct):
                    reads = model.readings(token)
                    out += [(r, int(t[k]), int(c[k]), int(beside[k])) for r in reads]
                for d, reads in spaced:
                    x = int(toxic[i:j][d] > 0)
                    out += [(r, x, 1 - x, x << (d % 63)) for r in {w for read in reads for w in read.split()}]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *(pa.array([o[q] for o in out], pa.int64()) for q in (1, 2, 3))], ["word", "t", "c", "beside"])
        hash_64.cache_clear()  # the worker lives on in other stages

    by_word = rows.mapInArrow(lean(count), "word string, t long, c long, beside long").where("word <> ''").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.bit_or("beside").alias("beside"))
    starts = F.array("word", *(F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in (3, 4, 5, 6)))
    by = by_word.select(F.explode(starts).alias("feature"), "t", "c", "beside").where("feature is not null").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.bit_or("beside").alias("beside"))
    tally = rows.groupBy("toxic").count().collect()
    n_bad, n_good = (sum(r["count"] for r in tally if (r["toxic"] > 0) == want) for want in (True, False))
    weight = F.log((F.col("t") + 0.5) / (n_bad + 1.0)) - F.log((F.col("c") + 0.5) / (n_good + 1.0))
    chosen = by.where((F.col("t") >= least) & (F.bit_count("beside") >= least)).select("feature", weight.alias("w")).where(F.col("w") >= sure)
    weights = {r["feature"]: float(r["w"]) for r in chosen.collect()} if n_bad else {}  # of `most` rows at most
    scorer = Scorer(model, weights)

    def summed(batches):
        for batch in batches:
            for i, j, data, firsts in lowered_slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(scorer.sums(data, firsts)), batch.column(1).slice(i, j - i)], ["s", "toxic"])
        scorer.forget()

    fit = rows.mapInArrow(lean(summed), "s double, toxic int").toPandas()  # two numbers for each of at most `most` rows
    x, y = np.log1p(fit["s"].to_numpy(np.float64)), (fit["toxic"].to_numpy() > 0).astype(np.float64)
    a, b = 1.0, -3.0
    for _ in range(50):  # Newton's steps for a logistic curve, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(x * (y - p)).sum() - 0.05 * a, (y - p).sum() - 0.05 * b])
        h = p * (1 - p)
        m = np.array([[(x * x * h).sum() + 0.05, (x * h).sum()], [(x * h).sum(), h.sum() + 0.05]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a + step[0], b + step[1]
    scorer.a, scorer.b = max(float(a), 0.0), float(b)
    return scorer


@lru_cache(maxsize=100_000)
def hash_64(word: str) -> int:
    """A fixed hash to 0..62."""
    import zlib

    return zlib.crc32(word.encode()) % 63


def scored(docs: DataFrame, scorer: Scorer, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each row. Null texts count as empty; repeated doc_ids stay separate; other columns are ignored; a null doc_id is held out of nothing (false)."""

    def run(batches):
        for batch in batches:
            for i, j, data, firsts in lowered_slices(batch.column(2)):
                p = scorer.probabilities(scorer.sums(data, firsts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        scorer.forget()

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """doc_id, held_out, score, predicted of each row: learn() and scored() in one.

    Null and empty texts score what a text without evidence does; repeated doc_ids stay separate rows; very long texts are scored whole; other
    columns are ignored; without usable labels all score low; an empty table gives an empty result.
    """
    return scored(docs, learn(docs, labels, **kw))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **kw) -> DataFrame:
    """The rows of docs, all columns, that score below threshold. The texts are scored where they stand: no join, no shuffle of texts.

    Null and empty texts stay; repeated rows are judged each; columns may have any names; an empty table gives an empty result.
    """
    scorer = learn(docs, labels, **kw)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            keep = np.concatenate([scorer.probabilities(scorer.sums(data, firsts)) < threshold for _, _, data, firsts in lowered_slices(batch.column(at))] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep, pa.bool_()))
        scorer.forget()

    return docs.mapInArrow(lean(run), docs.schema)
