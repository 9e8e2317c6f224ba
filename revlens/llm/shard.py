"""Sharding by minimax contiguous partition: groups of equal texts in a fixed order, the smallest capacity of a shard found by binary search with greedy checks, cuts there.

Only DataFrame functions. The rows are read once into a table of some 50 bytes a row; groups, running sums and slots are made from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.llm.common import forget, written

#: Rows or groups that one task numbers at a time, about; no result depends on it.
BLOCK = 100_000
#: Capacities that a job of the binary search checks side by side.
ABREAST = 63


def hashed(text) -> F.Column:
    """The first 60 bits of md5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), k (the row's hash, by which a shard's rows are in order), size, text_crc32, row (a number of its own) of each row, written."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.when(F.col("text").isNull(), F.lit(-1)).otherwise(hashed("text")).alias("h"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    named = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("h").cast("string"))
    return written(rows.select("doc_id", "h", hashed(named).alias("k"), "size", "text_crc32", F.monotonically_increasing_id().alias("row")), "sized")


def giants(groups: DataFrame, shards: int) -> list[tuple[int, int]]:
    """(h, size) of groups of more than an equal share of what is left: each fills a shard of its own. There are fewer than shards of them."""
    left, out = groups.agg(F.sum("size")).first()[0] or 0, []
    for r in groups.orderBy(F.desc("size"), "h").limit(shards - 1).collect():
        if r["size"] * (shards - len(out)) <= left:
            break
        out.append((r["h"], r["size"]))
        left -= r["size"]
    return out


def running(groups: DataFrame, block: int) -> DataFrame:
    """h, end (sum of sizes so far) of groups in the order of h, written. Hashes are even, so ranges of them are tasks of like size; only the ranges' sums are in one window."""
    n = groups.count()
    shift = 60 - max(0, (n // block).bit_length())
    ranged = groups.withColumn("part", F.shiftright("h", shift))
    before = ranged.groupBy("part").agg(F.sum("size").alias("all"))
    before = before.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    own = F.sum("size").over(Window.partitionBy("part").orderBy("h"))
    return written(ranged.select("h", "part", own.alias("own")).join(before, "part").select("h", (F.col("own") + F.col("before")).alias("end")), "running")


def reached(ends: DataFrame, limits: list[int], largest: int) -> list[int]:
    """For each limit the last end up to it (0: none). It is less than the largest group away, so that the filter skips most of the table, which is in order."""
    near = ends.where((F.col("end") > min(limits) - largest) & (F.col("end") <= max(limits)))
    return [r or 0 for r in near.agg(*(F.max(F.when(F.col("end") <= x, F.col("end"))) for x in limits)).first()]


def capacity(ends: DataFrame, total: int, largest: int, shards: int) -> int:
    """The smallest capacity with which greedy filling needs no more than shards shards: at least an equal share and the largest group, at most their sum.

    Binary search, ABREAST halvings at a time: their greedy checks take one job a shard together.
    """
    share = -(-total // shards)
    low, high = max(share, largest), share + largest
    while low < high:
        tried = sorted({low + (high - low) * i // (ABREAST + 1) for i in range(ABREAST + 1)})
        at = [0] * len(tried)
        for _ in range(shards):
            at = reached(ends, [a + c for a, c in zip(at, tried)], largest)
        fits = [i for i, a in enumerate(at) if a == total]
        first = fits[0] if fits else len(tried)
        high = tried[first] if fits else high
        low = tried[first - 1] + 1 if first else high
    return low


def cuts(ends: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """The h of the last group of each shard but the last: no shard is over the smallest capacity, and within that each cut is the last end up to an even share, so that no shard is left short.

    A cut can't lie before what greedy filling from the other side needs.
    """
    if shards < 2 or not total:
        return []
    most, least = capacity(ends, total, largest, shards), [total]
    for _ in range(shards - 1):
        bound = least[-1] - most
        near = ends.where((F.col("end") >= bound) & (F.col("end") < bound + largest))
        least.append(near.agg(F.min("end")).first()[0] if bound > 0 else 0)
    at, out = 0, []
    for k in range(1, shards):
        at = max(least[shards - k], reached(ends, [min(at + most, k * total // shards)], largest)[0])
        out.append(at)
    named = {r["end"]: r["h"] for r in ends.where(F.col("end").isin(*out)).collect()}
    return [named.get(at, -2) for at in out]


def numbered(rows: DataFrame, block: int) -> DataFrame:
    """rows with slot: their place in their shard, in the order of k. Ranges of k are numbered side by side; many rows of one k are copies of one row, and dealt out."""
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    rows = rows.withColumn("part", F.shiftright("k", 60 - (most // block).bit_length()))
    count = rows.groupBy("shard", "part").count()
    hot = written(count.where(F.col("count") > 4 * block).select("shard", "part", F.ceil(F.col("count") / block).alias("blocks")), "hot")
    if hot.isEmpty():
        dealt = rows.withColumn("cell", F.lit(0).cast("long"))
    else:
        dealt = rows.join(hot, ["shard", "part"], "left").withColumn("cell", F.coalesce(F.pmod(F.xxhash64("row"), F.col("blocks")), F.lit(0).cast("long")))
    cells = dealt.groupBy("shard", "part", "cell").count()
    before = cells.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("part", "cell")) - F.col("count")).drop("count")
    before = written(before, "before")
    own = F.row_number().over(Window.partitionBy("shard", "part", "cell").orderBy("k", "row"))
    return dealt.withColumn("own", own).join(before, ["shard", "part", "cell"]).withColumn("slot", F.col("own") + F.col("before") - 1)


def sharded(docs: DataFrame, shards: int = 8, block: int = BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null) of each row of docs (doc_id, text).

    Rows of equal texts are in one shard; null texts, of one byte and the crc of nothing, are a group, empty ones another. Groups of more than an equal share have a shard each, the first ones; the others are cut
    in the order of their hash into shards of nearly equal bytes, none over the smallest capacity that contiguous shards allow. With few groups some shards are empty. Rows that share a doc_id
    stay separate rows; null doc_ids stay null. The slots are in the order of a hash of doc_id and text; equal rows have neighbouring slots in any order (beyond 4 * block of them: in blocks, with what lies between them).
    Long texts are whole. Other columns are ignored. An empty table gives an empty result.
    """
    rows = sized(docs)
    groups = written(rows.groupBy("h").agg(F.sum("size").alias("size")), "groups")
    alone = giants(groups, shards)
    rest = groups.where(~F.col("h").isin(*(h for h, _ in alone))) if alone else groups
    facts = rest.agg(F.sum("size"), F.max("size")).first()
    ends = running(rest, block)
    after = cuts(ends, facts[0] or 0, facts[1] or 0, shards - len(alone))
    forget(groups, ends)
    shard = F.lit(len(alone))
    for h in after:
        shard = shard + (F.col("h") > h).cast("int")
    for i, (h, _) in enumerate(alone):
        shard = F.when(F.col("h") == h, i).otherwise(shard)
    out = numbered(rows.withColumn("shard", shard.cast("int")), block)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle(shards: int = 8) -> str:
    """The same in DuckDB's SQL: one step of the recursion is one look-up of the binary search, one cut from the right, or one cut."""
    return f"""
with recursive crcs as materialized (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crcs),
skips as materialized (  -- what 256 more bytes do to each bit of a crc
  select list_transform(range(32), lambda j: list_reduce(list_prepend((1::bigint << j), list_transform(range(256), lambda i: 0::bigint)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) as skip from crcs),
begins as materialized (  -- the crc's beginning after so many zero bytes
  select list_transform(range(256), lambda n: list_reduce(list_prepend(4294967295::bigint, list_transform(range(n), lambda i: 0::bigint)), lambda c, b: xor(c >> 8, crcs[(c & 255) + 1]))) as begin from crcs),
texts as materialized (
  select text, strlen(text) as n, hex(encode(text)) as hx from (select distinct coalesce(text, '') as text from documents)),
pieces as materialized (  -- 256 bytes each, zeros before the first
  select text, n, i, list_reduce(list_prepend(0::bigint, list_transform(range(256), lambda j: ('0x' || substr(piece, 2 * j + 1, 2))::bigint)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])) as raw
  from (select text, n, i, lpad(case when i = 0 then left(hx, 2 * (n % 256)) else substr(hx, 2 * (n % 256) + 512 * (i - 1) + 1, 512) end, 512, '0') as piece from (select *, unnest(range(n // 256 + 1)) as i from texts)), crcs),
summed as materialized (
  select text, xor(list_reduce(list_prepend(xor(begin[n % 256 + 1], list(raw order by i)[1]), list(raw order by i)[2:]),
    lambda c, r: xor(r, list_reduce(list_transform(range(32), lambda j: case when (c >> j) & 1 = 1 then skip[j + 1] else 0 end), lambda x, y: xor(x, y)))), 4294967295)::bigint as crc
  from pieces, skips, begins group by text, n, skip, begin),
sized as materialized (
  select doc_id, case when d.text is null then -1 else ('0x' || substr(md5(d.text), 1, 15))::bigint end as h,
    (coalesce(strlen(d.text), 0) + 1)::bigint as size, crc from documents d join summed s on s.text = coalesce(d.text, '')),
ranked as (
  select h, sum(size)::bigint as size, row_number() over (order by sum(size) desc, h) as r,
    coalesce(sum(sum(size)) over (order by sum(size) desc, h rows between unbounded preceding and 1 preceding), 0)::bigint as before, sum(sum(size)) over ()::bigint as every from sized group by h),
alone as materialized (
  select h, r - 1 as shard, size from (select *, bool_and(r < {shards} and size * ({shards} - r + 1) > every - before) over (order by r) as giant from ranked) where giant),
ends as materialized (select h, size, sum(size) over (order by h)::bigint as ended from ranked where h not in (select h from alone)),
facts as materialized (select coalesce(max(ended), 0) as total, coalesce(max(size), 0) as largest, {shards} - (select count(*) from alone) as shards from ends),
search as (
  select greatest((total + shards - 1) // shards, largest) as low, (total + shards - 1) // shards + largest as high, 0::bigint as pos, 0::bigint as k, 0::bigint as step from facts
  union all
  select case when k < shards or pos >= total then low else (low + high) // 2 + 1 end,
    case when pos >= total then (low + high) // 2 else high end,
    case when k < shards and pos < total then (select coalesce(max(ended), 0) from ends where ended <= s.pos + (s.low + s.high) // 2) else 0 end,
    case when k < shards and pos < total then k + 1 else 0 end, step + 1
  from search s, facts where low < high),
found as materialized (select min(high) as most from search),
rights as (
  select total as least, 0::bigint as k from facts
  union all
  select case when least > most then (select min(ended) from ends where ended >= r.least - most) else 0 end, k + 1 from rights r, found, facts where k < shards - 1),
lefts as (
  select 0::bigint as pos, 0::bigint as k
  union all
  select greatest((select least from rights where rights.k = facts.shards - l.k - 1), (select coalesce(max(ended), 0) from ends where ended <= least(l.pos + most, (l.k + 1) * total // shards))), k + 1
  from lefts l, found, facts where k < shards - 1),
placed as (
  select h, ((select count(*) from alone) + (select count(*) from lefts where k > 0 and pos < ended))::int as shard from ends
  union all select h, shard::int from alone),
named as (
  select doc_id, size, crc, shard, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/' || h::varchar), 1, 15))::bigint as k from sized join placed using (h))
select doc_id, size, crc as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by k) - 1 as slot, null::int as grown_shard
from named"""
