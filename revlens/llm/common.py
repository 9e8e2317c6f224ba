"""What several operators share: reading tables, row keys, places for files, connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs without these six white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only where it is unset, and all runs on this machine, one of our own (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "/tmp/checkpoints/revlens"
    return at.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of an execution go once it has ended; what it wrote is all that later ones read."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, kind: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it from there: that cuts its lineage, and later reads take only the columns that they need."""
    at = new_path(df.sparkSession, kind)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def modest_batches(spark: SparkSession) -> None:
    """Lets no Arrow batch be much over 4 MB, so that workers' memory doesn't depend on how long texts are. A value that the session has set itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(4 << 20))


def hand_back() -> None:
    """Gives what a worker has freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(f):
    """f, a function of batches, that hands back what it has freed once a task is over: its worker lives on, beside those of later stages."""

    def run(batches):
        yield from f(batches)
        hand_back()

    return run


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one where df has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def forget(*dfs: DataFrame) -> None:
    """Deletes what written() wrote for these, once nothing will read it again."""
    for df in dfs:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c):
    """Lower-cases A-Z only, as the contracts ask; lower() would change other letters too."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def most_frequent(table: DataFrame, name: str, count: str, most: int) -> F.Column:
    """Whether a row (name, count) is among the most frequent ones, of which there are about `most` at most. A histogram of counts on a log scale finds how frequent they must
    be, so that no more than these come to the driver: a sort with a limit would send as many from every partition. Of a band that would be too many, a share by hash is taken."""
    band = F.floor(F.log2(count) * 16).cast("int")
    n = 0
    for r in sorted(table.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["band"]):
        if n + r["n"] > most:
            part = F.pmod(F.xxhash64(F.lit(5), name), F.lit(1 << 20)) < int((most - n) / r["n"] * (1 << 20))
            return (band > r["band"]) | ((band == r["band"]) & part)
        n += r["n"]
    return F.lit(True)


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find over edges (a long, b long): (node, comp), comp the smallest node reachable.

    Each round hangs every node on its smallest neighbour, follows these pointers to their roots by doubling, and
    contracts the edges to roots; rounds and doublings are logarithmic in the usual case. Hot nodes are met by
    partial minima before a shuffle and by joins whose partitions Spark can split. Nodes are the ends of edges
    (an edge from a node to itself counts); null ends are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and a <= b and b is not null")
    e = written(e.distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"), F.lit(False).alias("moved")), "up")
        while True:
            over = up.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            jumped = written(up.join(over, "comp").select("node", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")), "up")
            forget(up)
            up = jumped
            if up.where("moved").isEmpty():
                break
        ends = [up.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
        left = e.join(ends[0], "a").join(ends[1], "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        left = written(left.distinct(), "edges")
        forget(e)
        e = left
        if state is None:
            state = up
        else:
            step = up.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            joined = written(state.join(step, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"), F.lit(False).alias("moved")), "state")
            forget(state, up)
            state = joined
        if e.isEmpty():
            forget(e)
            out = state.select("node", "comp")
            out.written_at = state.written_at
            return out
