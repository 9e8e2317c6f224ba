"""Labels of inducing changes: blame joins, issue chains, flags and the bug matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blamed(deleted: DataFrame, blame: DataFrame) -> DataFrame:
    """(fix, inducing, file): blame ranges (fix, old_path, inducing, file, lo, hi) that hold a deleted line (fix, old_path, line).

    An equi-join on commit and path; the range is checked on what meets.
    """
    hit = deleted.join(blame, ["fix", "old_path"]).where("line between lo and hi")
    return hit.select("fix", "inducing", "file").distinct()


def in_range(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: float, keys: list[str]) -> DataFrame:
    """points x ranges with equal keys and lo <= at <= hi, by buckets of width: ranges are spread over the buckets that they touch, so
    the join is on equal buckets even where there are no keys."""
    b = points.withColumn("bucket", F.floor(F.col(at) / width).cast("long"))
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long"))))
    return b.join(r, [*keys, "bucket"]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("bucket")


def issue_chain(actions: DataFrame, commits: DataFrame, issues: DataFrame, link: str, kind: str) -> DataFrame:
    """(rev, file, bug_id): inducing file actions by way of the issues that the changes they are blamed for fix.

    actions: (action_id, rev, file, induces array<struct<change_file_action_id, szz_type>>); commits: (rev, <link> array of issue ids);
    issues: (issue_id, <kind>, status). Hard suspects don't count; the issue must be a resolved bug.
    """
    led = actions.select("action_id", F.col("rev").alias("bad_rev"), F.col("file").alias("bad_file"), F.explode("induces").alias("i")).where("i.szz_type <> 'hard_suspect'")
    fix = led.join(actions.select(F.col("action_id").alias("fix_id"), "rev"), F.col("i.change_file_action_id") == F.col("fix_id")).join(commits.select("rev", F.explode(link).alias("issue_id")), "rev")
    good = issues.where((F.lower(F.col(kind)) == "bug") & F.lower("status").isin("resolved", "fixed", "closed"))
    return fix.join(good.select("issue_id"), "issue_id").select(F.col("bad_rev").alias("rev"), F.col("bad_file").alias("file"), F.col("issue_id").alias("bug_id")).distinct()


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """bug_ids (sorted) of each row by (rev, file), [] where there are none."""
    lists = labels.groupBy("rev", "file").agg(F.array_sort(F.collect_set("bug_id")).alias("bug_ids"))
    return rows.join(lists, ["rev", "file"], "left").withColumn("bug_ids", F.coalesce("bug_ids", F.array().cast("array<string>")))


def flags(rows: DataFrame, inducing: DataFrame) -> DataFrame:
    """pascarella_commit and pascarella_file: whether the commit, and the commit's file, induced a fix."""
    c = inducing.select("rev").distinct().withColumn("c", F.lit(True))
    f = inducing.select("rev", "file").distinct().withColumn("f", F.lit(True))
    out = rows.join(c, "rev", "left").join(f, ["rev", "file"], "left")
    return out.withColumn("pascarella_commit", F.coalesce("c", F.lit(False))).withColumn("pascarella_file", F.coalesce("f", F.lit(False))).drop("c", "f")


def bug_matrix(rows: DataFrame, labels: DataFrame, bugs: list[str]) -> DataFrame:
    """A 0/1 column for each bug, by (rev, file). The list of bugs is given, so the pivot doesn't ask for it first."""
    wide = labels.groupBy("rev", "file").pivot("bug_id", bugs).agg(F.max(F.lit(1)))
    out = rows.join(wide, ["rev", "file"], "left")
    return out.na.fill(0, bugs)


def numbered_bugs(labels: DataFrame) -> DataFrame:
    """(bug_id, no): the bugs numbered from 0 without gaps, in 256 parts by hash: no task sees all of them."""
    from pyspark.sql.window import Window

    part = labels.select("bug_id").distinct().withColumn("part", F.substring(F.sha2("bug_id", 256), 1, 2))
    before = part.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("bug_id"))
    return part.withColumn("own", own).join(before, "part").select("bug_id", (F.col("own") + F.col("before") - 1).alias("no"))


def blocks(rows: DataFrame, labels: DataFrame, numbers: DataFrame, lo: int, hi: int, keys: list[str]) -> DataFrame:
    """The bug matrix's columns lo to before hi: (keys..., a 0/1 column for each bug of these numbers) of all rows (rev, file, keys...), whatever the number of bugs. Only this block's ids come to the driver."""
    some = numbers.where(F.col("no").between(lo, hi - 1))
    names = [r["bug_id"] for r in some.orderBy("no").collect()]
    own = labels.join(some.select("bug_id"), "bug_id", "left_semi")
    return bug_matrix(rows.select(*dict.fromkeys(["rev", "file", *keys])), own, names).select(*dict.fromkeys([*keys, *names]))


def majority_key(keys: DataFrame) -> DataFrame:
    """The most frequent key of each commit, the smallest on a tie. keys: (rev, key)."""
    n = keys.groupBy("rev", "key").agg(F.count("*").alias("n"))
    return n.groupBy("rev").agg(F.min_by("key", F.struct((-F.col("n")).alias("n"), "key")).alias("key"))


def validated_fixes(links: DataFrame, hunks: DataFrame) -> DataFrame:
    """(rev, file) of commits with at most one qualifying issue that have a verified line. links: (rev, issue_id); hunks: (rev, file, verified)."""
    many = links.groupBy("rev").agg(F.count("*").alias("n")).where("n > 1")
    return hunks.where("verified").select("rev", "file").distinct().join(many, "rev", "left_anti")


#: The label names of validated chains; all others are custom ones.
VALIDATED = ("JLMIV+R", "JLMIVLV")


def labelled(name: str):
    return lambda i: i["label"] == F.lit(name)


def label_relation(names: list[str], actions: DataFrame, commits: DataFrame, issues: DataFrame) -> DataFrame:
    """(label, rev, file, bug_id) of all named labels: validated ones go by the issues that commits fix and their verified type, custom ones by linked issues and their own type; of the suspects just
    those with the label count. actions' induces has (change_file_action_id, szz_type, label)."""
    out = None
    for name in names:
        link, kind = ("fixed_issue_ids", "issue_type_verified") if name in VALIDATED else ("linked_issue_ids", "issue_type")
        own = actions.withColumn("induces", F.filter("induces", labelled(name)))
        rows = issue_chain(own, commits, issues, link, kind).select(F.lit(name).alias("label"), "rev", "file", "bug_id")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("label_relation: no label")
    return out


def message_issues(commits: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """(rev, external_id, issue_id): issues (external_id, issue_id) that messages (rev, msg) name by key and number."""
    from revlens.functions.columns import issue_keys

    named = commits.select("rev", F.explode(issue_keys(F.col("msg"), key)).alias("external_id")).distinct()
    return named.join(issues.select("external_id", "issue_id"), "external_id")


def before_report(suspects: DataFrame, at: str = "inducing_ts", created: str = "created_at") -> DataFrame:
    """Suspects that weren't committed after the issue was reported."""
    return suspects.where(F.col(at) <= F.col(created))


def changed_modes(actions: DataFrame, mode: str = "mode") -> DataFrame:
    """File actions that are neither copies nor renames, in any case of letters."""
    return actions.where(~F.lower(mode).isin("c", "r"))


def last_modified(deleted: DataFrame, blame: DataFrame) -> DataFrame:
    """(fix, file, commits): the commits, sorted, that last changed the deleted lines of each file of a fix."""
    return blamed(deleted, blame).groupBy("fix", "file").agg(F.array_sort(F.collect_set("inducing")).alias("commits"))


def unique_inducing(fixes: DataFrame, deleted: DataFrame, blame: DataFrame, most: int = 50, until=None) -> DataFrame:
    """(inducing, file): distinct changes that fixes (fix, ts, n_mods) of fewer than most files, up to a date, are blamed on."""
    small = fixes.where(F.col("n_mods") < most)
    if until is not None:
        small = small.where(F.col("ts") <= until)
    return blamed(deleted.join(small.select("fix"), "fix", "left_semi"), blame).select("inducing", "file").distinct()


def hunk_lines(hunks: DataFrame, keys: list[str], text: bool = True) -> DataFrame:
    """(keys..., no, sign, text, old, new): the lines of diff hunks (keys..., content), and how many old and new lines stand before each. A hunk's keys are its own. text: whether the lines' texts are wanted.

    Hunks are shuffled before they are cut into lines, and where no texts are wanted just as a sign for each line: windows over their lines need no other shuffle.
    """
    from pyspark.sql.window import Window

    cut = F.split(F.regexp_replace("content", "\r\n|\r", "\n"), "\n")
    sign = lambda line: F.when(line.startswith("+"), "+").when(line.startswith("-"), "-").otherwise(" ")
    if text:
        lines = hunks.select(*keys, "content").repartition(*keys).select(*keys, F.posexplode(cut).alias("no", "line")).select(*keys, "no", sign(F.col("line")).alias("sign"), F.expr("substring(line, 2)").alias("text"))
    else:
        lines = hunks.select(*keys, F.array_join(F.transform(cut, sign), "").alias("signs")).repartition(*keys).select(*keys, F.posexplode(F.split("signs", "")).alias("no", "sign"))
    w = Window.partitionBy(*keys).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda s: F.coalesce(F.sum(F.when(F.col("sign") == s, 0).otherwise(1)).over(w), F.lit(0))
    return lines.select("*", before("+").alias("old"), before("-").alias("new"))


def changed_lines(lines: DataFrame, keys: list[str], old_start: str, new_start: str, verified: DataFrame) -> DataFrame:
    """(keys..., line, kind): added, deleted and verified lines by number, out of hunk_lines() with the hunks' first numbers. verified: (keys..., no) of lines that a person marked as part of the fix."""
    # a hunk's verified lines come as one row, by the hundred, so that lines stay where hunk_lines() has put them
    part = lambda: F.floor(F.col("no") / 256).cast("long")
    sure = verified.where("no is not null").groupBy(*keys, part().alias("part")).agg(F.collect_set("no").alias("some"))
    sure = sure.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("part", "some"))).alias("sure"))
    # one pass over the lines: their running counts are a window, which each further use would run again
    line = F.when(F.col("sign") == "+", F.col(new_start) + F.col("new")).otherwise(F.col(old_start) + F.col("old"))
    gone = F.when(F.array_contains(F.element_at("sure", part()), F.col("no")), F.array(F.lit("deleted"), F.lit("verified"))).otherwise(F.array(F.lit("deleted")))
    kinds = F.when(F.col("sign") == "+", F.array(F.lit("added"))).otherwise(gone)
    return lines.where("sign in ('+', '-')").join(sure, keys, "left").select(*keys, line.alias("line"), F.explode(kinds).alias("kind"))
