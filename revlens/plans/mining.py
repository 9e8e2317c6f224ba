"""Mining a Git repository end to end: one row for each changed file of each commit, with all measures and the bug matrix.

python -m revlens.plans.mining PATH OUT [--language java] [--until 2017-12-31]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.constants import BUG_KEYWORDS, QUALITY_KEYWORDS
from revlens.functions import columns as C
from revlens.operators import commits as commit_ops
from revlens.operators import graph, history, labels, lineage, store
from revlens.plans import complete
from revlens.sources import git
from revlens.streaming import incremental

#: Endings of the files that tell of the build.
BUILD_FILES = "pom.xml,project.xml"


def path_numbers(spark: SparkSession, commits: DataFrame) -> DataFrame:
    """(rev, pathnum): the first path of the cover that holds the commit."""
    rows = commits.select("rev", "parents").collect()
    children: dict[str, list[str]] = {}
    for r in rows:
        for p in r["parents"]:
            children.setdefault(p, []).append(r["rev"])
    first: dict[str, int] = {}
    base = 0
    for r in rows:
        if not r["parents"]:
            paths = graph.path_cover(r["rev"], children)
            for k, path in enumerate(paths):
                for rev in path:
                    first.setdefault(rev, base + k)
            base += len(paths)
    return spark.createDataFrame(list(first.items()) or [("", -1)], "rev string, pathnum int")


def changes(spark: SparkSession, commits: DataFrame, mods: DataFrame, language: str) -> DataFrame:
    """All changes against the first parent, with effective kinds, names and oldest names; tracked: whether the language's filter keeps them."""
    m = mods.where("parent_num = 0")
    ok = lambda c: C.language_file(language, F.col(c))
    m = m.withColumn("kind", C.effective_change(F.col("change_type"), ok("old_path"), ok("new_path"))).withColumn("tracked", F.col("kind").isNotNull())
    m = m.withColumn("name", C.file_name(F.coalesce("kind", "change_type"), F.col("old_path"), F.col("new_path")))
    m = m.join(commits.select("rev", "seq", F.col("committer_ts").alias("date"), "author", "msg"), "rev")
    m = m.withColumn("at", F.struct("seq", "mod_idx"))
    moves = lineage.oldest_names(m.where("kind = 'RENAME'").select("at", "old_path", "new_path"))
    m = lineage.names_as_of(m.withColumnRenamed("name", "path"), moves).withColumnRenamed("path", "name")
    return m.select(
        "rev", "seq", "date", "author", "msg", "mod_idx", "kind", "tracked", "name", F.col("oldest").alias("file"),
        C.subsystem(F.col("name")).alias("subsystem"), C.directory(F.col("name")).alias("directory"),
        F.col("added").cast("long").alias("added"), F.col("removed").cast("long").alias("removed"), F.col("nloc").cast("long").alias("nloc"),
        F.count("*").over(Window.partitionBy("rev")).alias("n_mods"),
    )


def blamed_lines(commits: DataFrame, mods: DataFrame, lines: DataFrame, language: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fixes, deleted, blame) as labels.blamed() and labels.unique_inducing() take them: fixing commits without merges, the lines of code that they delete from the language's files, and what last changed those lines before."""
    fix = commits.where("fix and size(parents) = 1").select(F.col("rev").alias("fix"), F.col("parents")[0].alias("before"), F.col("committer_local").alias("ts"))
    own = mods.where("parent_num = 0").join(fix, F.col("rev") == F.col("fix"))
    fixes = own.groupBy("fix", "ts").agg(F.count("*").alias("n_mods"))
    name = C.file_name(F.col("change_type"), F.col("old_path"), F.col("new_path"))
    touched = own.where((F.col("change_type") != "ADD") & C.language_file(language, name)).select("fix", "before", "old_path")
    gone = lines.where("parent_num = 0 and kind = 'deleted'").select(F.col("rev").alias("fix"), F.col("path").alias("old_path"), "line", "text")
    deleted = store.kept(gone.join(touched, ["fix", "old_path"]).where(C.code_line(F.col("text"))).select("fix", "before", "old_path", "line"), "deleted")
    origins = lineage.line_origins(commits, mods, lines, deleted.select("fix", F.col("before").alias("rev"), F.col("old_path").alias("path"), "line"))
    return fixes, deleted.select("fix", "old_path", "line"), store.kept(origins.select("fix", F.col("path").alias("old_path"), "inducing", "file", "lo", "hi"), "blame")


def bug_ids(commits: DataFrame) -> DataFrame:
    """(fix, bug_id): the fix and its local time with the distance from UTC."""
    off = F.col("tz_offset_min")
    zone = F.concat(F.when(off < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(off) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(off) % 60).cast("string"), 2, "0"))
    return commits.select(F.col("rev").alias("fix"), F.concat(F.lit("adhoc__"), "rev", F.lit("__"), F.date_format("committer_local", "yyyy-MM-dd HH:mm:ss"), zone).alias("bug_id"))


def mine(spark: SparkSession, path: str, language: str = "java", keywords=BUG_KEYWORDS, until: str | None = None, extra: complete.Extra | None = None, matrix: bool = True, state: str | None = None) -> DataFrame:
    """The feature rows of a repository. until bounds the rows that are given, not what they count. extra: tables that complete the rows. Without matrix, rows have their bug_ids as a list, not a column each (see labels.blocks()). state: a folder
    that keeps what has been read for the next run, so that only new commits are diffed (see incremental.facts())."""
    extra = extra or complete.Extra()
    git.register(spark)
    at = store.scratch(spark, "mine")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    read = lambda table, **kw: spark.read.format("revlens_git").options(path=path, table=table, nloc=table == "modifications", **kw).load()
    c = kept(read("commits"), "commits")
    if state:
        known = incremental.facts(spark, path, state, {"modifications": {"nloc": True}, "lines": {}, "contents": {"endings": BUILD_FILES}})
        table = lambda name: known[name].join(c.select("rev"), "rev", "left_semi")
    else:
        table = lambda name: kept(read(name, **({"endings": BUILD_FILES} if name == "contents" else {})), name)
    c = kept(c.join(lineage.ordered(c.select("rev", "parents", F.col("committer_ts").alias("date"), "place")), "rev").withColumn("fix", C.any_substring(F.col("msg"), list(keywords))), "ordered")
    mods = table("modifications")
    m = kept(changes(spark, c, mods, language).join(c.select("rev", "fix"), "rev"), "changes")
    # windows are ordered by the commits' place: it stands in for the time of order, dates stay for ages
    own = kept(m.withColumn("ts", F.timestamp_seconds("seq")), "in_order")
    t = own.where("tracked")
    ages = history.with_file_measures(t).drop("age")
    w = Window.partitionBy("file").orderBy("seq", "mod_idx")
    here, last = F.count("*").over(Window.partitionBy("file", "rev")), F.lag("date").over(w)
    full = ages.withColumn("age", F.when((here > 1) | last.isNull(), 0).otherwise(C.days_between(F.col("date"), last)).cast("long"))
    cc = c.select("rev", F.timestamp_seconds("seq").alias("ts"), F.year("committer_local").alias("year"), "author")
    full = kept(full, "files")
    full = history.with_commit_shares(history.with_minor(history.with_ownership(full)), own)
    full = kept(history.with_neighbours(kept(full, "owned")), "neighbours")
    full = kept(history.with_project_measures(history.with_nsctr(full, own), cc), "project")
    years = cc.withColumn("rexp", F.count("*").over(history.so_far("author", "year"))).withColumn("kamei_exp", F.count("*").over(history.so_far("author"))).select("rev", "rexp", "kamei_exp")
    full = full.join(years, "rev").join(commit_ops.size_measures(own), "rev").join(commit_ops.history_measures(full.select("rev", "ts", "file", "author", "mod_idx", "age")), "rev")
    full = full.join(commit_ops.experience(full, cc), "rev")
    topics = list(QUALITY_KEYWORDS)
    full = history.topic_counts(full, c.select("rev", *(C.any_token(F.col("msg"), list(QUALITY_KEYWORDS[k])).alias(k) for k in topics)), topics)
    full = kept(full, "measured")
    lines = table("lines")
    more: list[str] = []
    before = set(full.columns)
    if extra.warnings is not None:
        full = kept(complete.with_linter(full, extra, c, lines), "linted")
    if extra.metrics is not None:
        full = kept(complete.with_static(full, extra, c)[0], "static")
    if extra.builds:
        full = kept(complete.with_builds(full, table("contents"), c), "builds")
    for plugin in extra.plugins:
        full = kept(plugin(full, {"commits": c, "modifications": mods, "lines": lines}), f"plugin-{plugin.__name__}")
    full, named = complete.with_labels(full, extra)
    more = [x for x in full.columns if x not in before]
    fixes, deleted, blame = blamed_lines(c, mods, lines, language)
    names = full.select("rev", "name", "file").distinct()
    placed = lambda hits: hits.select(F.col("inducing").alias("rev"), F.col("file").alias("name")).join(names, ["rev", "name"]).select("rev", "file").distinct()
    adhoc = labels.blamed(deleted, blame)
    lab = kept(adhoc.join(bug_ids(c), "fix").select(F.col("inducing").alias("rev"), "file", "bug_id").distinct(), "inducing")
    if named is not None:
        lab = kept(lab.unionByName(named), "labels")
    bugs = [] if not matrix else sorted(r["bug_id"] for r in lab.select("bug_id").distinct().collect())
    full = history.previous_inducing(full, placed(adhoc))
    full = labels.flags(full, placed(labels.unique_inducing(fixes, deleted, blame, until=F.lit(until).cast("timestamp_ntz") if until else None)))
    full = full.join(path_numbers(spark, c), "rev").join(c.select("rev", "committer_local", "tz_offset_min"), "rev")
    rows = full.select(
        F.col("rev").alias("commit"), "seq", "mod_idx", F.col("date").alias("committer_date"), "committer_local", "tz_offset_min", F.col("name").alias("file"), F.col("file").alias("oldest_name"),
        F.col("kind").alias("change_type"), "comm", "adev", "ddev", "add", "del", "own", "minor", F.col("kamei_ns").alias("sctr"), F.col("kamei_nd").alias("nd"), F.col("kamei_entropy").alias("entropy"),
        "la", "ld", "lt", "cexp", "rexp", "sexp", "nuc", "age", "oexp", "exp", "nsctr", "ncomm", "nadev", "nddev", "previous_inducing", F.col("fix").alias("fix_bug"), F.col("fix").alias("kamei_fix"),
        "kamei_ns", "kamei_nd", "kamei_nf", "kamei_la", "kamei_ld", "kamei_entropy", "kamei_exp", "kamei_ndev", "kamei_nuc", "kamei_age", "kamei_lt", "kamei_sexp", "kamei_rexp",
        "pascarella_commit", "pascarella_file", *(f"quality_{k}{end}" for k in topics for end in ("", "_commit")), "pathnum", *more,
    )
    rows = rows.withColumnRenamed("commit", "rev")
    if not matrix:
        rows = labels.with_labels(rows, lab)
    elif bugs:
        rows = labels.bug_matrix(rows, lab, bugs)
    if until:
        rows = rows.where(F.col("committer_local") <= F.lit(until).cast("timestamp_ntz"))
    return rows.withColumnRenamed("rev", "commit")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("path")
    p.add_argument("out")
    p.add_argument("--language", default="java")
    p.add_argument("--until")
    p.add_argument("--builds", action="store_true")
    p.add_argument("--state")
    a = p.parse_args()
    spark = SparkSession.builder.appName("revlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store.write_csv(mine(spark, a.path, a.language, until=a.until, extra=complete.Extra(builds=a.builds), state=a.state), a.out)


if __name__ == "__main__":
    main()
