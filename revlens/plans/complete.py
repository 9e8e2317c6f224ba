"""What a mined row has beside its history: the linter's outputs, static metrics, build settings, labels of an issue tracker."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import builds, labels, linter, poms, static
from revlens.operators.store import kept

#: The settings of a build that a row tells.
FLAGS = ["use_pmd", "use_checkstyle", "use_findbugs", "use_custom_rules"]


@dataclass
class Extra:
    """Tables that complete the rows; those that are None add no columns.

    warnings (rev, file, line, rule) and sizes (rev, file, lloc) of a linter over all files of each commit, with the names of its default rules; metrics (rev, file, name, value) of an issue tracker's
    miner; bugfixes (rev, file) that were validated; named (label, rev, file, bug_id) as labels.label_relation() gives them; builds: whether build files are read.
    plugins: functions of the touches (rev, file, name, mod_idx, seq, ...) and the tables (commits, modifications, lines) that give the touches, each once, with columns of their own.
    """

    warnings: DataFrame | None = None
    sizes: DataFrame | None = None
    default_rules: tuple[str, ...] = ()
    metrics: DataFrame | None = None
    bugfixes: DataFrame | None = None
    named: DataFrame | None = None
    builds: bool = False
    plugins: tuple[Callable[[DataFrame, dict[str, DataFrame]], DataFrame], ...] = ()


def lint_table(extra: Extra, commits: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rev, file, lloc, warnings, default_warnings, effective_warnings, warning_list, added), (rev, file, linter_deleted_warnings)): of each file of each commit, with the rules of its warnings on added lines; and the rules of the parent's warnings on lines that are deleted."""
    w = extra.warnings
    changed = lambda kind: lines.where(f"parent_num = 0 and kind = '{kind}'").select("rev", F.col("path").alias("file"), "line").distinct()
    rules = lambda of, name: of.groupBy("rev", "file").agg(F.sort_array(F.collect_list("rule")).alias(name))
    parents = commits.select("rev", F.get("parents", F.lit(0)).alias("parent"))
    before = w.withColumnRenamed("rev", "parent").join(parents, "parent").select("rev", "file", "line", "rule")
    count = w.groupBy("rev", "file").agg(F.count("*").alias("warnings"), F.count(F.when(F.col("rule").isin(*extra.default_rules), 1)).alias("default_warnings"))
    out = extra.sizes.join(count, ["rev", "file"], "left").na.fill(0, ["warnings", "default_warnings"]).withColumn("effective_warnings", F.lit(0).cast("long"))
    for part, name in ((w, "warning_list"), (linter.on_changed_lines(w, changed("added")), "added")):
        out = out.join(rules(part, name), ["rev", "file"], "left")
    # a file that is gone has no row of its own: its deleted warnings are joined to the touch
    gone = rules(linter.on_changed_lines(before, changed("deleted")), "linter_deleted_warnings")
    return out, gone


def with_linter(t: DataFrame, extra: Extra, commits: DataFrame, lines: DataFrame) -> DataFrame:
    """t (rev, name, file, mod_idx, ts, author, ...) with the linter's outputs."""
    lint, gone = lint_table(extra, commits, lines)
    c = commits.select("rev", F.timestamp_seconds("seq").alias("ts"), "author", F.get("parents", F.lit(0)).alias("parent"))
    out = linter.row_outputs(t.select("rev", "file", "name", "mod_idx", "ts", "author"), kept(lint, "lint"), c)
    none = F.array().cast("array<string>")
    out = t.join(out, ["rev", "file", "mod_idx"]).join(gone.withColumnRenamed("file", "name"), ["rev", "name"], "left")
    return out.withColumn("linter_deleted_warnings", F.coalesce("linter_deleted_warnings", none))


def with_static(t: DataFrame, extra: Extra, commits: DataFrame) -> tuple[DataFrame, list[str]]:
    """t with a column for each metric of its file: the commit's, the first parent's and the difference, 0 where a side lacks it; rows of commits that the miner doesn't know are left out. The names that there are come to the driver: they are its columns."""
    parents = commits.select("rev", F.get("parents", F.lit(0)).alias("parent"))
    long = kept(static.assembled(extra.metrics, parents, ["file"]), "static")
    names = sorted(r["name"] for r in long.select("name").distinct().collect())
    table = static.wide(long, names).withColumnRenamed("file", "name")
    known = extra.metrics.select("rev").distinct()
    return t.join(known, "rev", "left_semi").join(table, ["rev", "name"], "left").na.fill(0, names), names


def with_builds(t: DataFrame, files: DataFrame, commits: DataFrame) -> DataFrame:
    """t (rev, seq, name, ...) with use_maven and FLAGS of the build as it stands at each commit. files: (rev, path, text), the build files of each commit that touches one."""
    own = files.withColumnRenamed("text", "xml")
    records, errors = poms.built(own, ["rev"])
    records = records.withColumn("use_custom_rules", F.size("custom_rule_files") > 0)
    touched = commits.join(own.select("rev").distinct(), "rev").select("rev", "seq")
    spans = kept(builds.settings_so_far(touched, errors, records, FLAGS), "settings")
    return builds.with_settings(t, spans, FLAGS)


def with_labels(t: DataFrame, extra: Extra) -> tuple[DataFrame, DataFrame]:
    """(t with validated_bugfix, further labels (rev, file, bug_id)): ids of named labels begin with the label."""
    if extra.bugfixes is not None:
        fix = extra.bugfixes.select("rev", F.col("file").alias("name")).distinct().withColumn("validated_bugfix", F.lit(True))
        t = t.join(fix, ["rev", "name"], "left").na.fill(False, ["validated_bugfix"])
    named = None if extra.named is None else extra.named.select("rev", "file", F.concat_ws("__", "label", "bug_id").alias("bug_id")).distinct()
    return t, named
