"""Fuzzy line deduplication by MinHash (operator 7), in DataFrame functions only.

A line's shingles are all its windows of SHINGLE characters. Equal lines are one class with a number; classes
whose signatures agree in a band share a bucket, and pairs of a bucket are verified by exact Jaccard: all pairs of a small bucket at once; in a
large one each class with LEADS others first, and then all pairs that are left across the components that the links so far give.
Union-find joins what holds, and of each component the first line in order of (doc_id, line number) stays.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.common import components, forget, free_name, written

SHINGLE = 8
#: Bytes of a character, and of a window, in UTF-32, where places are found without counting.
CHAR, WIDE = 4, 4 * SHINGLE
#: A pair of similarity 0.75 meets with probability 1 - (1 - 0.75**ROWS)**BANDS = 0.977, one of 0.85 with 0.9993.
BANDS, ROWS = 10, 4
SHARE = 0.75
#: Classes of a bucket that is compared whole at once; of a larger one, LEADS are compared with all others before the rest is.
SMALL, LEADS = 24, 4
#: Classes of a bucket that are compared at once with as many others.
BLOCK = 512


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, no, norm): the lines of all texts; norm is lower-case and trimmed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("no", "line"))
    return rows.select("doc_id", "no", F.lower(F.trim("line")).alias("norm"))


def named(lines: DataFrame) -> DataFrame:
    """Adds two hashes that together tell lines apart."""
    return lines.withColumn("id", F.xxhash64("norm")).withColumn("id2", F.xxhash64(F.lit(1), "norm"))


def classes_of(lines: DataFrame) -> DataFrame:
    """(cid, id, id2, norm, place, n) of each distinct line but the empty one, written: cid is a number of its own, place its first one, n how often it stands."""
    by = lines.where("norm <> ''").groupBy("id", "id2").agg(F.first("norm").alias("norm"), F.min(F.struct("doc_id", "no")).alias("place"), F.count("*").alias("n"))
    return written(by.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")


def once(value, use) -> F.Column:
    """use(value), where value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def places(wide) -> F.Column:
    """The first byte, from 1, of each window in UTF-32."""
    return F.sequence(F.lit(1), F.octet_length(wide) - (WIDE - 1), F.lit(CHAR))


def shingles(norm) -> F.Column:
    """The distinct hashes of all windows of a line of at least SHINGLE characters."""
    return F.array_distinct(once(F.encode(norm, "UTF-32"), lambda x: F.transform(places(x), lambda at: F.xxhash64(F.substring(x, at, F.lit(WIDE))))))


def windows(classes: DataFrame) -> DataFrame:
    """(cid, h): a hash, of 32 bits, of every window of the lines long enough to have one."""
    wide = classes.where(F.length("norm") >= SHINGLE).select("cid", F.encode("norm", "UTF-32").alias("wide"))
    at = wide.select("cid", "wide", F.explode(places("wide")).alias("at"))
    return at.select("cid", F.hash(F.substring("wide", F.col("at"), F.lit(WIDE))).alias("h"))


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, cid): one row for each class and band."""
    rng = random.Random(11)
    salt = [rng.getrandbits(32) - (1 << 31) for _ in range(BANDS * ROWS)]
    least = windows(classes).groupBy("cid").agg(*(F.min(F.col("h").bitwiseXOR(F.lit(c).cast("int"))).alias(f"m{k}") for k, c in enumerate(salt)))
    keys = F.array(*(F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)))
    return least.select("cid", F.explode(keys).alias("key"))


def shared(keys: DataFrame) -> DataFrame:
    """(key, cid, n) of buckets of more than one class, n their size."""
    return keys.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")


def small(keys: DataFrame) -> DataFrame:
    """(key, cid, comp) of buckets (key, cid, n) of at most SMALL classes, each class a component of its own; of buckets with the same classes one stays."""
    own = keys.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("cid")).alias("cids"))
    one = own.groupBy("cids").agg(F.min("key").alias("key"))
    return one.select("key", F.explode("cids").alias("cid")).withColumn("comp", F.col("cid"))


def candidates(keys: DataFrame) -> DataFrame:
    """(a, b) pairs of each bucket: every class with the one before it and with LEADS of it, in an order by hash. Spark's window spills where a bucket is large."""
    w = Window.partitionBy("key").orderBy(F.xxhash64("cid"), "cid")
    others = F.filter(F.array(F.lag("cid").over(w), *(F.nth_value("cid", k + 1).over(w) for k in range(LEADS))), lambda x: x.isNotNull() & (x != F.col("cid")))
    pair = keys.select("cid", others.alias("others")).select("cid", F.explode("others").alias("o"))
    return pair.select(F.least("cid", "o").alias("a"), F.greatest("cid", "o").alias("b")).distinct()


def across(keys: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, cid, comp) of the buckets that more than one component of (node, comp) shares, written. A class without links is its own component."""
    w = Window.partitionBy("key")
    now = keys.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"))
    now = now.withColumn("low", F.min("comp").over(w)).withColumn("high", F.max("comp").over(w)).where("low < high")
    return written(now.drop("low", "high"), "across")


def alike(g, h, share: float) -> F.Column:
    """Whether two arrays of distinct values have a Jaccard similarity of at least share."""
    n, m = F.size(g), F.size(h)
    return (F.least(n, m) >= share * F.greatest(n, m)) & (F.size(F.array_intersect(g, h)) * (1 + share) >= share * (n + m))


def texts_of(keys: DataFrame, classes: DataFrame, sent: int = 1_000_000) -> DataFrame:
    """(cid, norm) of the classes that share a bucket, written. Their list goes to all tasks if it has at most sent numbers, so that most lines stay where they are; else both sides are shuffled."""
    ids = written(keys.select("cid").distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= sent else ids
    out = written(classes.select("cid", "norm").join(side, "cid", "left_semi"), "texts")
    forget(ids)
    return out


def rest(mixed: DataFrame, texts: DataFrame, share: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links between classes of one bucket of (key, cid, comp) that are in different components so far, written.

    All pairs across components are compared, in arrays: a bucket is dealt out by pairs of blocks of about block classes
    (of block * 500 characters, where lines are long), so no pairs leave a task. A pair of several buckets is compared in that of the least key.
    """
    own_keys = mixed.groupBy("cid").agg(F.collect_list("key").alias("keys"))  # BANDS at most
    sized = mixed.select("key", "cid", "comp").join(texts.join(own_keys, "cid").select("cid", "norm", "keys"), "cid")
    blocks = written(sized.groupBy("key").agg(F.ceil(F.greatest(F.count("*"), F.sum(F.length("norm")) / 500) / block).cast("int").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    met = sized.join(blocks, "key").select("key", "blocks", own.alias("own"), "cid", "comp", "norm", "keys")
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), F.struct("cid", "comp", "own", "norm", "keys").alias("x"))
    cells = met.groupBy("key", "i", "j").agg(F.collect_list("x").alias("xs"))
    full = F.transform("xs", lambda x: F.struct(x["cid"].alias("cid"), x["comp"].alias("comp"), x["own"].alias("own"), x["keys"].alias("keys"), shingles(x["norm"]).alias("g")))

    def links(xs):
        def partners(x):
            # a pair of one block counts in the cell of the block with itself only
            here = lambda y: (x["cid"] < y["cid"]) & (x["comp"] != y["comp"]) & ((F.col("i") == F.col("j")) | (x["own"] != y["own"]))
            held = F.filter(xs, lambda y: here(y) & (F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("key")) & alike(x["g"], y["g"], share))
            return F.transform(held, lambda y: F.struct(x["cid"].alias("a"), y["cid"].alias("b")))

        return F.flatten(F.transform(xs, partners))

    out = written(cells.select(F.explode(once(full, links)).alias("l")).select("l.a", "l.b"), "links")
    forget(blocks)
    return out


def similar(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) of classes (cid, norm) whose lines have a Jaccard similarity of at least share, written. Texts meet, not windows: their hashes take eight times the room."""
    pairs = written(pairs, "pairs")
    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("norm").alias("ta")), "a").join(texts.select(F.col("cid").alias("b"), F.col("norm").alias("tb")), "b")
    n, m = F.length("ta"), F.length("tb")
    sides = F.struct(shingles("ta").alias("g"), shingles("tb").alias("h"))
    out = written(both.where((n >= SHINGLE) & (m >= SHINGLE)).where(once(sides, lambda x: alike(x["g"], x["h"], share))).select("a", "b"), "links")
    forget(pairs)
    return out


def joined_classes(classes: DataFrame, share: float) -> DataFrame:
    """(node, comp) of the classes that links join, written."""
    keys = written(shared(band_keys(classes)), "keys")
    texts = texts_of(keys, classes)
    few = written(small(keys), "small")
    links = rest(few, texts, share)
    large = keys.where(F.col("n") > SMALL)
    more = similar(candidates(large), texts, share)
    comp = components(links.union(more))
    left = across(large, comp)
    last = rest(left, texts, share)
    if not last.isEmpty():
        forget(comp)
        comp = components(links.union(more).union(last))
    forget(keys, texts, few, links, more, left, last)
    return comp


def decisions(docs: DataFrame, share: float = SHARE, checked: int = 1_000_000) -> DataFrame:
    """doc_id, n_lines, n_kept, dropped (line numbers from 0, ascending) of each doc_id.

    Blank lines stay and count; an empty or null text is one blank line. Lines of fewer than SHINGLE characters are
    dropped as exact copies only. Rows that share a doc_id count together, and equal lines at the same place of
    them are one. Rows with a null doc_id form one group that comes first. Other columns are ignored. An empty table gives an empty
    result. Very long texts are whole; a single line may have up to 2**28 characters. The list of repeated lines (32 bytes each) is sent to all tasks only
    if it has at most checked entries; else both sides are shuffled.
    """
    lines = named(lines_of(docs))
    classes = classes_of(lines)
    comp = joined_classes(classes, share)
    tied = classes.select("cid", "id", "id2", "place", "n").join(comp.withColumnRenamed("node", "cid"), "cid", "left").where("n > 1 or comp is not null")
    tied = written(tied.select("id", "id2", "place", F.coalesce("comp", "cid").alias("g")), "tied")
    first = written(tied.groupBy("g").agg(F.min("place").alias("keep")), "first")
    chosen = written(tied.join(first, "g").select("id", "id2", "keep"), "chosen")
    forget(classes, comp, tied, first)
    side = F.broadcast(chosen) if chosen.limit(checked + 1).count() <= checked else chosen
    marked = lines.select("doc_id", "no", "id", "id2").join(side, ["id", "id2"], "left")
    # a blank line's hashes are in no class
    gone = F.col("keep").isNotNull() & ~(F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.no") == F.col("no")))
    return marked.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(~gone, 1)).alias("n_kept"), F.sort_array(F.collect_set(F.when(gone, F.col("no")))).alias("dropped"))


def deduplicated(docs: DataFrame, share: float = SHARE, checked: int = 1_000_000, sent: int = 16 << 20) -> DataFrame:
    """docs with its own columns, texts without the dropped lines. A document all of whose lines go, blank ones aside, goes itself; one that had no line but blank ones stays.

    Null and empty texts stay as they are; rows of one doc_id lose the same line numbers. Column names may be any. The lists of dropped lines are
    sent to all tasks if they take at most sent bytes; else both sides meet by doc_id.
    """
    names = docs.columns
    of, dropped = free_name(docs, "of"), free_name(docs, "dropped")
    some = written(decisions(docs, share, checked).where(F.size("dropped") > 0).select(F.col("doc_id").alias(of), F.col("dropped").alias(dropped)), "dropped")
    size = some.agg(F.count("*").alias("n"), F.sum(F.size(dropped)).alias("k")).first()
    side = F.broadcast(some) if 48 * size["n"] + 4 * (size["k"] or 0) <= sent else some
    rows = docs.join(side, docs["doc_id"].cast("long").eqNullSafe(F.col(of)), "left")
    had = F.col(dropped)
    stays = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), had)
    kept = F.array_join(once(F.split("text", "\n"), lambda x: F.transform(stays(x), lambda i: F.get(x, i))), "\n")
    rows = rows.withColumn("text", F.when(had.isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept))
    rows = rows.where(had.isNull() | (F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"\s+", " ")) != ""))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(had.isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*names)
