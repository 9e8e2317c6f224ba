"""Benchmark decontamination by spaced seeds (operator 4), in DataFrame functions only.

Each mask picks some of a few neighbouring words; the hashes of what it picks join items and documents at
any place, so words between the picked ones may differ. Around each hit the aligned words of both are
compared: an item leaks where of WINDOW aligned words, the hit's own among them, enough are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import lower_ascii, written

#: Word positions that each mask looks at. Any WINDOW words of which a quarter is substituted contain one of these patterns, as do 10 to 12 words.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 5), (0, 1, 2, 5))
#: Masks by the least size of an item: where three quarters of 4 to 9 words are left, two neighbours are; of three words or fewer all must be left.
BY_SIZE = ((10, MASKS), (4, ((0, 1),)), (3, ((0, 1, 2),)), (2, ((0, 1),)), (1, ((0,),)))
#: Into so many parts a seed is dealt out by documents where both sides are shuffled.
SALTS = 8
WINDOW = 13
#: Places of a text that are worked on at once.
CHUNK = 4096
SHARE = 0.75


def numbered_masks() -> list[tuple[int, int | None, list[tuple[int, tuple]]]]:
    """(least size, size that is too large, [(number, mask)]) of each class of sizes; numbers are of one mask in one class."""
    out, k, above = [], 0, None
    for least, masks in BY_SIZE:
        out.append((least, above, [(k + j, m) for j, m in enumerate(masks)]))
        k, above = k + len(masks), least
    return out


def word_hashes(text) -> F.Column:
    """Hashes of the words of a text, A-Z lower-cased."""
    words = F.split(F.trim(F.regexp_replace(lower_ascii(text), r"[\x09-\x0D]", " ")), " +")
    return F.filter(F.transform(words, lambda w: F.xxhash64(w)), lambda h: h != F.xxhash64(F.lit("")))


def chunks(hashes: DataFrame, keep: list[str], reach: range) -> DataFrame:
    """(keep..., n, base, begin, part): texts (keep..., h) of n words in chunks of CHUNK places from base on; part has their words and those within reach, from word begin on.

    Made by a function that isn't compiled into a stage, chunks are given one at a time: what a stage holds is bounded for texts of any length.
    """
    part = lambda h, k: F.struct((k * CHUNK).alias("base"), F.greatest(k * CHUNK + reach[0], F.lit(0)).alias("begin"), F.size(h).alias("n"), F.slice(h, F.greatest(k * CHUNK + reach[0], F.lit(0)) + 1, CHUNK + len(reach)).alias("part"))
    every = F.transform(F.array("h"), lambda h: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(h) - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: part(h, k)))[0]
    return hashes.select(*keep, F.explode(every).alias("c")).select(*keep, "c.*")


def seeds(parts: DataFrame, keep: list[str], masks) -> DataFrame:
    """(keep..., begin, part, at, key) for each place and mask (number, positions). The place is generated and looked up in one pass, without a copy of the array."""
    last = F.greatest(F.least(F.col("base") + CHUNK, "n") - 1, "base")
    h = parts.select(*keep, "n", "begin", "part", F.explode(F.sequence("base", last)).alias("at"))
    at = F.col("at")
    # a place too near the end for a mask gives a null, which joins nothing
    keys = [F.when(at + max(m) < F.col("n"), F.xxhash64(F.lit(k), *(F.get("part", at - F.col("begin") + i) for i in m))) for k, m in masks]
    return h.select(*keep, "begin", "part", "at", F.explode(F.array(*keys)).alias("key"))


def about(reach: range) -> F.Column:
    """The words about the place at, null outside. Made by a generator, the array is computed within the stage, and no array of a whole chunk leaves it."""
    step = F.col("at") - F.col("begin")
    return F.explode(F.array(F.array(*(F.when(step + k >= 0, F.get("part", step + k)) for k in reach))))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = SHARE, sent: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, matched, doc_word, places): the items (item_id, text) that documents (doc_id, text) hold, with at most
    a quarter of window words substituted: the most equal words of a window, the first word of the document at
    which one begins, and the number of hits that hold.

    Items shorter than window words must hold with share of theirs; those of fewer than four words hold with all of them, as a phrase.
    Null and empty texts, and rows without an id, hold nothing. Rows of one doc_id count together, as do items of one
    item_id. Items and documents may be of any length. Other columns are ignored; empty tables give an empty result.

    A seed of an item carries just the words about it, and equal ones of an item count in one row. The seeds are sent to all tasks
    if they take at most sent bytes; else both sides are shuffled by seed.
    """
    spans = max(max(m) for m in MASKS)
    reach = range(spans + 1 - window, window)  # aligned words that can share a window with the hit
    known = items.select("item_id", word_hashes(F.col("text")).alias("h")).where("item_id is not null and size(h) > 0").withColumn("size", F.size("h"))
    sizes = {r["size"] for r in known.select(F.least("size", F.lit(BY_SIZE[0][0])).alias("size")).distinct().collect()}
    masks, mine = [], None
    for least, above, own in numbered_masks():
        if any(n >= least and (above is None or n < above) for n in sizes):  # masks that no item needs aren't looked up in texts
            few = known.where(F.col("size") >= least) if above is None else known.where((F.col("size") >= least) & (F.col("size") < above))
            part = seeds(chunks(few, ["item_id", "size"], reach), ["item_id", "size"], own)
            masks, mine = masks + own, part if mine is None else mine.unionByName(part)
    if mine is None:
        masks = numbered_masks()[0][2]
        mine = seeds(chunks(known, ["item_id", "size"], reach), ["item_id", "size"], masks)
    mine = mine.where("key is not null").select("item_id", "size", "key", about(reach).alias("beside"))
    mine = written(mine.groupBy("item_id", "size", "key", "beside").agg(F.count("*").alias("equal")), "seeds")
    few = mine.count() * (64 + 8 * len(reach)) <= sent
    theirs = docs.where("doc_id is not null and text is not null").select("doc_id", word_hashes(F.col("text")).alias("h"))
    cells = seeds(chunks(theirs, ["doc_id"], reach), ["doc_id"], masks).where("key is not null")
    if few:  # the words about a place are looked up after the join
        hits = cells.join(F.broadcast(mine), "key").select("doc_id", "item_id", "equal", "size", "beside", "at", about(reach).alias("near"))
    else:  # they go along with the seed; a frequent one is dealt out
        salted = mine.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = cells.select("doc_id", "at", "key", about(reach).alias("near")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    same = F.zip_with("near", "beside", lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(window - spans)), lambda s: F.aggregate(F.slice("same", s, window), F.lit(0), lambda n, e: n + e)))
    need = F.ceil(F.lit(share) * F.least(F.lit(window), "size")).cast("int")
    rows = hits.select("doc_id", "item_id", "equal", "at", need.alias("need"), same.alias("same"))
    # made by a generator, the number stays where it is: as a plain column the optimizer would move its terms into the join
    rows = rows.select("doc_id", "item_id", "equal", "at", "need", F.explode(F.array(best)).alias("matched")).where("matched >= need")
    return rows.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.min("at").cast("long").alias("doc_word"), F.sum("equal").alias("places"))


def clean(docs: DataFrame, items: DataFrame, checked: int = 1_000_000, **kw) -> DataFrame:
    """The rows of docs that hold no item; rows without a doc_id stay, as do null and empty texts; rows of one doc_id go together; column names may be any.

    Only ids are gathered; while at most checked (8 bytes each), they are sent to the texts, else both sides meet by doc_id.
    """
    ids = written(leaks(docs, items, **kw).select("doc_id").distinct(), "leaks")
    side = F.broadcast(ids) if ids.limit(checked + 1).count() <= checked else ids
    return docs.join(side, "doc_id", "left_anti").select(*docs.columns)


def oracle(window: int = WINDOW, share: float = SHARE) -> str:
    """The same in DuckDB: words at places instead of hashes."""
    words = r"""list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D]', ' ', 'g'), ' +'), lambda x: x <> '')"""
    spans = max(max(m) for m in MASKS)
    every = [(k, m, f"i.n >= {least}" + (f" AND i.n < {above}" if above else "")) for least, above, own in numbered_masks() for k, m in own]
    on = " UNION ALL ".join(f"SELECT d.doc_id, d.pos AS dp, i.item_id, i.pos AS p, i.n, {k} AS mask FROM dw d JOIN iw i ON {of} AND " + " AND ".join(f"d.w{j} = i.w{j}" for j in m) + f" AND i.pos + {max(m)} < i.n" for k, m, of in every)
    lead = ", ".join(f"lead(w, {j}) OVER (PARTITION BY {{0}} ORDER BY pos) AS w{j}" for j in range(1, spans + 1))
    return f"""
WITH d0 AS (SELECT doc_id, {words} AS ws FROM documents),
d1 AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d0 WHERE len(ws) >= 1),
dw AS (SELECT doc_id, pos, w AS w0, {lead.format("doc_id")} FROM d1),
i0 AS (SELECT item_id, {words} AS ws FROM benchmark),
i1 AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM i0 WHERE len(ws) >= 1),
iw AS (SELECT item_id, n, pos, w AS w0, {lead.format("item_id")} FROM i1),
hit AS ({on}),
cell AS (SELECT DISTINCT h.doc_id, h.item_id, h.dp, h.p, k, (d.w IS NOT NULL)::INT AS e
  FROM (SELECT DISTINCT doc_id, item_id, dp, p FROM hit) h, range({spans + 1 - window}, {window}) r(k)
  LEFT JOIN i1 i ON i.item_id = h.item_id AND i.pos = h.p + k
  LEFT JOIN d1 d ON d.doc_id = h.doc_id AND d.pos = h.dp + k AND d.w = i.w),
best AS (SELECT doc_id, item_id, dp, p, s, sum(e) AS m FROM cell, range({spans + 1 - window}, 1) q(s) WHERE k >= s AND k < s + {window} GROUP BY ALL),
found AS (SELECT doc_id, item_id, dp, p, max(m) AS matched FROM best GROUP BY ALL),
kept AS (SELECT h.doc_id, h.item_id, h.dp, f.matched FROM hit h JOIN found f USING (doc_id, item_id, dp, p) WHERE f.matched >= ceil({share} * least({window}, h.n)))
SELECT doc_id, item_id, max(matched)::BIGINT AS matched, min(dp)::BIGINT AS doc_word, count(*) AS places FROM kept GROUP BY ALL"""
