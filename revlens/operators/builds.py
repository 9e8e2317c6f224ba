"""Build files: module trees, rule sets, lookup by path prefix, state kept over failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def roots(poms: DataFrame, edges: DataFrame, ignored: str = r"(^|/)(target|archetype-resources)/") -> DataFrame:
    """Build files (pom) that no other one leads to. edges: (parent, child); ignored is a parameter."""
    return poms.where(~F.col("pom").rlike(ignored)).join(edges.select(F.col("child").alias("pom")), "pom", "left_anti")


def without_doubles(idents: DataFrame) -> DataFrame:
    """(pom, ident) less the roots that share an ident with a shorter one. idents: (pom, ident)."""
    best = idents.groupBy("ident").agg(F.min_by("pom", F.struct(F.length("pom").alias("n"), "pom")).alias("best"), F.count_distinct("pom").alias("n")).where("n > 1")
    drop = idents.join(best, "ident").where("pom <> best").select("pom").distinct()
    return idents.join(drop, "pom", "left_anti")


def expanded_rules(refs: DataFrame, rulesets: DataFrame) -> DataFrame:
    """(ident, rules sorted): refs (ident, ref, excluded array) name a rule, or a whole set, less what is excluded. rulesets: (ruleset, rules)."""
    name = F.element_at(F.split("ref", "/"), -1)
    both = refs.withColumn("name", name).withColumn("ruleset", F.regexp_replace(name, r"\.xml$", "")).join(rulesets, "ruleset", "left")
    own = F.when(F.col("rules").isNotNull(), F.array_except("rules", F.coalesce("excluded", F.array().cast("array<string>")))).when(F.col("name").endswith(".xml"), F.array().cast("array<string>")).otherwise(F.array("name"))
    return both.where("ref is not null").select("ident", F.explode(own).alias("rule")).groupBy("ident").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def by_prefix(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """The source folder that each path begins with, and its value, null where there is none: of several the one of the largest ord, where sources have one, else the longest.

    Each path is spread over its own prefixes, so the join is on equal strings and not on every pair.
    sources: (source, value[, ord]).
    """
    best = F.col("ord") if "ord" in sources.columns else F.length("source")
    parts = F.split("path", "/")
    spread = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("source"))
    hit = spread.join(sources, "source").groupBy("path").agg(F.max_by(F.struct("source", "value"), best).alias("s"))
    return paths.join(hit, "path", "left").select("path", F.col("s.source").alias("source"), F.col("s.value").alias("value"))


def kept_state(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The last value that isn't null, so far: a failed parse keeps the state before. rows with seq."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(f"{value}_kept", F.last(value, ignorenulls=True).over(w))


#: Kinds of failures that leave the state of the build before; all others are errors of the run.
KEPT = ("child", "malformed", "parse", "unique", "version_missing", "unknown_packaging", "plugin_missing", "parent", "xml_syntax")


def with_policy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds info_kept and failed. rows: commits (keys..., seq) with touched (whether a build file changed), error (kind or null) and info.

    Only commits that touch a build file give a new state; after a failure of the kinds KEPT the state before holds; any other kind is failed, and gives no state either.
    """
    fresh = F.col("touched") & F.col("error").isNull()
    out = kept_state(rows.withColumn("info_new", F.when(fresh, F.col("info"))), "info_new", keys)
    return out.withColumn("failed", F.col("touched") & F.col("error").isNotNull() & ~F.col("error").isin(*KEPT)).withColumnRenamed("info_new_kept", "info_kept").drop("info_new")


def memo(parsed: DataFrame, empty: str = "{}") -> DataFrame:
    """(rev, info): one entry a revision; of a revision whose build files could not be read, an empty one. parsed: (rev, info or null)."""
    return parsed.groupBy("rev").agg(F.coalesce(F.max("info"), F.lit(empty)).alias("info"))


def holding(words: str):
    return lambda x: x.contains(words)


def error_line(output, kinds):
    """The last line of a build's output that holds the words of its kind (see build_error), null if unknown."""
    lines = F.split(output, "\n")
    found = F.lit(None).cast("string")
    for _, words in kinds:
        hit = F.get(F.reverse(F.filter(lines, holding(words))), F.lit(0))
        found = F.when(output.contains(words), hit).otherwise(found)
    return found


def rewritten_parents(poms: DataFrame, rules: DataFrame) -> DataFrame:
    """poms (pom, group, artifact, version, relative) with the parent that can be resolved: rules (group, artifact, version, new_version) replace what is no longer published, and a
    parent that isn't at a relative path loses -SNAPSHOT. The rules are a table to be given."""
    new = rules.select("group", "artifact", "version", "new_version")
    version = F.when(F.col("new_version").isNotNull(), F.col("new_version")).when(F.col("relative").isNull(), F.regexp_replace("version", "-SNAPSHOT$", "")).otherwise(F.col("version"))
    # few rules meet many files, which have few keys: by a shuffle, all files of a key would go to one task
    return poms.join(F.broadcast(new), ["group", "artifact", "version"], "left").select("pom", "group", "artifact", version.alias("version"), "relative")


def settings_so_far(touched: DataFrame, errors: DataFrame, records: DataFrame, flags: list[str]) -> DataFrame:
    """(state, seq, upto, source, flags...): the settings of each source folder from the commit seq on until before upto (null: to the end).

    touched: (rev, seq) of commits that touch a build file; errors (rev, error); records (rev, source_directory, flags...). After a failure of the kinds KEPT the settings before go on; any other
    kind leaves the build's settings as they are and is left to with_policy(). Of records of one folder the last by ident counts, where they have it. A row is a change of the build, so the order of them is one window.
    """
    good = touched.join(errors.select("rev"), "rev", "left_anti")
    w = Window.partitionBy(F.lit(1)).orderBy("seq")
    spans = good.withColumn("upto", F.lead("seq").over(w)).select("rev", "seq", "upto")
    pick = F.struct("ident") if "ident" in records.columns else F.struct("source_directory")
    last = records.groupBy("rev", F.col("source_directory").alias("source")).agg(*(F.max_by(f, pick).alias(f) for f in flags))
    return spans.join(last, "rev", "left").select(F.col("rev").alias("state"), "seq", "upto", "source", *flags)


def with_settings(rows: DataFrame, spans: DataFrame, flags: list[str]) -> DataFrame:
    """rows (rev, seq, name, ...) with use_maven and flags: the settings at their commit of the longest source folder that their name begins with; false where there is none. spans: settings_so_far()."""
    states = spans.select("state", "seq", "upto").distinct()
    has = spans.where("source is not null").select("state").distinct().withColumn("any", F.lit(True))
    from revlens.operators.labels import in_range

    ranges = states.select("state", F.col("seq").alias("lo"), (F.coalesce("upto", F.lit(1 << 40)) - 1).alias("hi"))
    last = rows.agg(F.max("seq")).first()[0] or 0
    when = in_range(rows.select("seq").distinct(), ranges.withColumn("hi", F.least("hi", F.lit(last))).where("lo <= hi"), "seq", "lo", "hi", max(1, last // 1000), []).select("seq", "state")
    out = rows.join(when, "seq", "left")
    parts = F.split("name", "/")
    prefixes = out.select("state", "name").distinct().select("state", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("source"))
    hit = prefixes.join(spans.drop("seq", "upto"), ["state", "source"]).groupBy("state", "name").agg(F.max_by(F.struct(*flags), F.length("source")).alias("s"))
    out = out.join(hit, ["state", "name"], "left").join(has, "state", "left")
    return out.select(*rows.columns, F.coalesce("any", F.lit(False)).alias("use_maven"), *(F.coalesce(F.col(f"s.{f}"), F.lit(False)).alias(f) for f in flags))
