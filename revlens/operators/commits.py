"""Measures of whole commits. mods: all changes (rev, subsystem, directory, added, removed, nloc); t: touches of tracked files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.operators.history import ORDER, first_of, reached, so_far


def size_measures(mods: DataFrame) -> DataFrame:
    """kamei_la, kamei_ld, kamei_lt, kamei_ns, kamei_nd, kamei_nf and kamei_entropy by commit."""
    own = mods.select("rev", "subsystem", "directory", "added", "removed", "nloc", (F.col("added") + F.col("removed")).alias("lines"))
    own = own.withColumn("all", F.sum("lines").over(Window.partitionBy("rev")))
    p = F.col("lines") / F.col("all")
    out = own.groupBy("rev").agg(
        F.sum("added").alias("kamei_la"),
        F.sum("removed").alias("kamei_ld"),
        (F.sum(F.coalesce("nloc", F.lit(0))) + F.sum("removed") - F.sum("added")).alias("kamei_lt"),
        F.count_distinct("subsystem").alias("kamei_ns"),
        F.count_distinct("directory").alias("kamei_nd"),
        F.count("*").alias("kamei_nf"),
        F.coalesce(F.sum(F.when(F.col("lines") > 0, -p * F.log2(p))), F.lit(0.0)).alias("kamei_entropy"),
    )
    return out


def experience(t: DataFrame, commits: DataFrame) -> DataFrame:
    """kamei_sexp, kamei_rexp by commit with tracked files: sums over its touches. commits may have the year, else it is that of ts."""
    sexp = t.groupBy("rev").agg(F.sum("sexp").alias("kamei_sexp"), F.count("*").alias("n"))
    c = commits.select("rev", "ts", "author", (F.col("year") if "year" in commits.columns else F.year("ts")).alias("year"))
    # one running count a calendar year, all in one window by author: no commit is joined with earlier ones
    years = sorted(r["year"] for r in c.select("year").distinct().collect())
    total = F.lit(0.0)
    for y in years:
        total = total + F.sum((F.col("year") == y).cast("long")).over(so_far("author")) / (F.abs(F.lit(y) - F.col("year")) + 1)
    rexp = c.select("rev", total.alias("r"))
    return sexp.join(rexp, "rev").select("rev", "kamei_sexp", (F.col("r") * F.col("n")).alias("kamei_rexp"))


def history_measures(t: DataFrame) -> DataFrame:
    """kamei_ndev, kamei_nuc, kamei_age by commit. t with age."""
    # of a commit of one file, both are running counts of that file; only where several files meet are histories joined
    run = t.withColumn("devs", F.sum(first_of("file", "author")).over(so_far("file"))).withColumn("revs", F.sum(first_of("file", "rev")).over(so_far("file")))
    per = run.groupBy("rev").agg(F.avg("age").alias("kamei_age"), F.min("file").alias("f1"), F.max("file").alias("f2"), F.max("devs").alias("devs"), F.max("revs").alias("revs"))
    several = t.join(per.where("f1 <> f2").select("rev"), "rev", "left_semi")
    ndev = reached(several, "author", t).groupBy("rev").agg(F.count("*").alias("n_dev"))
    nuc = reached(several, "rev", t).groupBy("rev").agg(F.count("*").alias("n_rev"))
    out = per.join(ndev, "rev", "left").join(nuc, "rev", "left")
    return out.select("rev", F.coalesce("n_dev", "devs").alias("kamei_ndev"), F.coalesce("n_rev", "revs").alias("kamei_nuc"), "kamei_age")


def sequence(commits: DataFrame) -> DataFrame:
    """seq: an increasing number in order of (ts, rev), by ranges: no single task sees all commits. Not dense."""
    laid = commits.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return laid.withColumn("seq", F.monotonically_increasing_id())
