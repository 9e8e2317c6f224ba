"""The model over the driver's tables: orders are commits, line items changes, customers authors, parts files.

orders -> commit rev, ordered by (o_orderdate, o_orderkey); lineitem -> change of the part; p_brand -> subsystem; p_type -> directory;
l_quantity, l_tax, l_linenumber -> added, removed, nloc; l_returnflag <> 'A' -> tracked; priority '1-URGENT' -> fix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Bytes of a table's files for which a shuffle has one partition, and bytes of shuffled rows up to which Spark puts partitions together again.
SHARE, LEAST = 4 << 20, 4 << 20
INITIAL, ADVISORY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: What grown_shuffles() has set: the folder of tables, and its values by key.
held: dict = {"at": None, "set": {}}


def grown_shuffles(spark: SparkSession, sf_dir: str, name: str) -> None:
    """Lets shuffles of queries on the tables of a folder begin with partitions in proportion to the largest table read, so that what a task holds doesn't grow with the tables. Values that the session has set itself stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    own = held["set"]
    before = int(own[INITIAL]) if held["at"] == (spark.sparkContext.applicationId, sf_dir) else 0
    want = {INITIAL: str(max(before, -(-size // SHARE), int(spark.conf.get("spark.sql.shuffle.partitions")))), ADVISORY: str(LEAST)}
    now = spark.conf.getAll
    for key, value in want.items():
        if key not in now or now[key] == own.get(key):
            spark.conf.set(key, value)
    held.update(at=(spark.sparkContext.applicationId, sf_dir), set=want)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    grown_shuffles(spark, sf_dir, name)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("rev"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"), (F.col("o_orderpriority") == "1-URGENT").alias("fix"))


def changes(spark, d) -> DataFrame:
    """All changes, tracked or not."""
    l = table(spark, d, "lineitem")
    row = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    l = l.select(
        F.col("l_orderkey").alias("rev"),
        F.col("l_partkey").alias("file"),
        F.col("l_quantity").cast("long").alias("added"),
        F.floor(F.col("l_tax") * 100).cast("long").alias("removed"),
        F.col("l_linenumber").cast("long").alias("nloc"),
        (F.col("l_returnflag") != "A").alias("tracked"),
        F.row_number().over(row).alias("mod_idx"),
        F.count("*").over(Window.partitionBy("l_orderkey")).alias("n_mods"),
    )
    p = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("subsystem"), F.col("p_type").alias("directory"))
    return l.join(commits(spark, d), "rev").join(p, "file")


def touches(spark, d) -> DataFrame:
    return changes(spark, d).where("tracked").drop("tracked")


def parents(spark, d) -> DataFrame:
    """The previous order of the same customer as parent."""
    w = Window.partitionBy("author").orderBy("ts", "rev")
    return commits(spark, d).withColumn("parent", F.lag("rev").over(w))


def lint(spark, d) -> DataFrame:
    """Warnings of a touch: its file's change size as warnings, lloc ten times the lines; one row a file and commit."""
    t = touches(spark, d)
    return t.groupBy("rev", "file").agg(F.sum("removed").alias("warnings"), F.sum(F.when(F.col("nloc") <= 3, F.col("removed")).otherwise(0)).alias("default_warnings"), F.sum(F.col("nloc") * 10).alias("lloc"))


def inducing(spark, d) -> DataFrame:
    """Changes that a later urgent order of the same part (within 30 days) fixes."""
    t = touches(spark, d).select("rev", "ts", "file", "fix")
    fixes = t.where("fix").select(F.col("ts").alias("fixed"), F.col("rev").alias("bug"), "file")
    hit = t.join(fixes, "file").where("rev <> bug and ts <= fixed and ts >= fixed - interval 30 days")
    return hit.select("rev", "file", F.concat(F.lit("bug"), (F.col("bug") % 5).cast("string")).alias("bug_id")).distinct()


#: The same for DuckDB.
SQL = """
c AS (SELECT o_orderkey AS rev, o_orderdate AS ts, o_custkey AS author, o_orderpriority = '1-URGENT' AS fix FROM orders),
m AS (SELECT l.l_orderkey AS rev, l.l_partkey AS file, l.l_quantity::BIGINT AS added, floor(l.l_tax * 100)::BIGINT AS removed, l.l_linenumber::BIGINT AS nloc, l.l_returnflag <> 'A' AS tracked,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) AS mod_idx,
  count(*) OVER (PARTITION BY l_orderkey) AS n_mods, c.ts, c.author, c.fix, p_brand AS subsystem, p_type AS directory
  FROM lineitem l JOIN c ON c.rev = l.l_orderkey JOIN part ON p_partkey = l.l_partkey),
t AS (SELECT * FROM m WHERE tracked)"""

INDUCING = """
inducing AS (SELECT DISTINCT t.rev, t.file, 'bug' || (f.rev % 5)::VARCHAR AS bug_id FROM t JOIN t f ON f.fix AND f.file = t.file AND f.rev <> t.rev AND t.ts <= f.ts AND t.ts >= f.ts - INTERVAL 30 DAY)"""

LINT = """
lint AS (SELECT rev, file, sum(removed) AS warnings, sum(CASE WHEN nloc <= 3 THEN removed ELSE 0 END) AS default_warnings, sum(nloc * 10) AS lloc FROM t GROUP BY ALL),
system AS (SELECT rev, sum(lloc) AS system_lloc, sum(warnings) AS system_warnings, sum(default_warnings) AS system_default, count(*) AS n_files FROM lint GROUP BY rev),
parent AS (SELECT *, lag(rev) OVER (PARTITION BY author ORDER BY ts, rev) AS parent FROM c)"""
