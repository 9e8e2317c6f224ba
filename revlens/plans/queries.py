"""Queries over the driver's tables, each with its SQL for DuckDB: names follow the operators' numbers in the survey."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.constants import BUG_KEYWORDS
from revlens.functions import columns as C
from revlens.operators import builds, commits, graph, history, labels, linter, static, store
from revlens.plans import analog as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def base(select: str, *more: str) -> str:
    return "WITH " + ",".join([A.SQL, *more]) + "\n" + select


ID = ("rev", "file", "mod_idx")
SO_FAR = "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
#: Histories of each touch for definitions by join: all touches of the file up to its commit.
PAST = "t h ON h.file = t.file AND (h.ts, h.rev) <= (t.ts, t.rev)"


def r(c: str):
    return C.rounded(F.col(c), 6).alias(c)


# ---------------------------------------------------------------- windows


def file_query(name: str, column: str, sql: str, rounded: bool = False):
    def f(spark, d):
        t = history.with_file_measures(A.touches(spark, d))
        return t.select(*ID, r(column) if rounded else column)

    query(name, base(sql))(f)


file_query("w1_comm", "comm", f"SELECT t.rev, t.file, t.mod_idx, count(*) AS comm FROM t JOIN {PAST} GROUP BY ALL")
file_query("w2_adev", "adev", f"SELECT t.rev, t.file, t.mod_idx, count(DISTINCT h.author) AS adev FROM t JOIN {PAST} GROUP BY ALL")
file_query("w3_ddev", "ddev", f"SELECT t.rev, t.file, t.mod_idx, count(DISTINCT h.author) AS ddev FROM t JOIN {PAST} GROUP BY ALL")
file_query("w4_nuc", "nuc", f"SELECT t.rev, t.file, t.mod_idx, sum((h.n_mods = 1)::INT)::BIGINT AS nuc FROM t JOIN {PAST} GROUP BY ALL")
file_query(
    "w5_age",
    "age",
    f"""SELECT rev, file, mod_idx, CASE WHEN len(d) < 2 THEN 0 ELSE floor((epoch(ts) - epoch(list_reverse_sort(d)[2])) / 86400)::BIGINT END AS age
FROM (SELECT t.rev, t.file, t.mod_idx, t.ts, list(h.ts) AS d FROM t JOIN {PAST} GROUP BY ALL)""",
)
file_query("w6_cexp", "cexp", f"SELECT rev, file, mod_idx, count(*) OVER (PARTITION BY author, file ORDER BY ts, rev {SO_FAR}) AS cexp FROM t")
file_query("w8_sexp", "sexp", "SELECT rev, file, mod_idx, dense_rank() OVER (PARTITION BY author, subsystem ORDER BY ts, rev) AS sexp FROM t")


@query("w7_rexp", base(f"SELECT rev, count(*) OVER (PARTITION BY author, year(ts) ORDER BY ts, rev {SO_FAR}) AS rexp, count(*) OVER (PARTITION BY author ORDER BY ts, rev {SO_FAR}) AS kamei_exp FROM c QUALIFY rev IN (SELECT rev FROM t)"))
def w7_rexp(spark, d):
    """Also W11."""
    t = A.touches(spark, d).select("rev").distinct()
    return history.with_author_measures(t, A.commits(spark, d)).select("rev", "rexp", "kamei_exp")


PROJECT = f"""
per AS (SELECT c.rev, c.ts, c.author, coalesce(sum(t.added + t.removed), 0) AS lines FROM c LEFT JOIN t ON t.rev = c.rev GROUP BY ALL),
run AS (SELECT *, sum(lines) OVER (PARTITION BY author ORDER BY ts, rev {SO_FAR}) AS own_lines, sum(lines) OVER (ORDER BY ts, rev {SO_FAR}) AS all_lines, count(*) OVER (ORDER BY ts, rev {SO_FAR}) AS n,
  sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (ORDER BY ts, rev {SO_FAR}) AS authors FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ts, rev) = 1 AS first FROM per))"""


@query("w9_oexp", base("SELECT rev, round(CASE WHEN all_lines > 0 THEN own_lines / all_lines ELSE 0 END, 6) AS oexp FROM run WHERE rev IN (SELECT rev FROM t)", PROJECT))
def w9_oexp(spark, d):
    t = A.touches(spark, d)
    return history.with_project_measures(t, A.commits(spark, d)).select("rev", r("oexp")).distinct()


@query("w10_exp", base("SELECT rev, round(n / authors, 6) AS exp FROM run WHERE rev IN (SELECT rev FROM t)", PROJECT))
def w10_exp(spark, d):
    t = A.touches(spark, d)
    return history.with_project_measures(t, A.commits(spark, d)).select("rev", r("exp")).distinct()


@query(
    "w12_nsctr",
    base("SELECT t.rev, t.file, t.mod_idx, count(DISTINCT s.subsystem) AS nsctr FROM t JOIN t h ON h.file = t.file AND h.author = t.author AND (h.ts, h.rev) <= (t.ts, t.rev) JOIN m s ON s.rev = h.rev GROUP BY ALL"),
)
def w12_nsctr(spark, d):
    return history.with_nsctr(A.touches(spark, d), A.changes(spark, d)).select(*ID, "nsctr")


NEIGHBOURS = f"""
f AS (SELECT DISTINCT rev, ts, file FROM t),
p AS (SELECT a.rev, a.file, b.file AS other, a.ts FROM f a JOIN f b ON a.rev = b.rev AND a.file <> b.file),
h AS (SELECT p.rev, p.file, count(DISTINCT h.rev) AS ncomm, count(DISTINCT h.author) AS nddev FROM p JOIN t h ON h.file = p.other AND (h.ts, h.rev) <= (p.ts, p.rev) GROUP BY ALL)"""


@query("w13_ncomm", base("SELECT f.rev, f.file, coalesce(ncomm, 0) AS ncomm, coalesce(nddev, 0) AS nddev FROM f LEFT JOIN h USING (rev, file)", NEIGHBOURS))
def w13_ncomm(spark, d):
    """Also W15."""
    t = history.with_file_measures(A.touches(spark, d))
    return history.with_neighbours(t).select("rev", "file", "ncomm", "nddev").distinct()


@query(
    "w14_nadev",
    base(
        "SELECT a.rev, a.file, a.mod_idx, coalesce(sum(b.adev) FILTER (b.file <> a.file), 0)::BIGINT AS nadev FROM ad a JOIN ad b ON a.rev = b.rev GROUP BY ALL",
        f"ad AS (SELECT t.rev, t.file, t.mod_idx, count(DISTINCT h.author) AS adev FROM t JOIN {PAST} GROUP BY ALL)",
    ),
)
def w14_nadev(spark, d):
    t = history.with_file_measures(A.touches(spark, d))
    return history.with_neighbours(t).select(*ID, "nadev")


TOTALS = f"tot AS (SELECT t.rev, t.file, t.mod_idx, t.author AS me, h.author, sum(h.added + h.removed) AS lines, min((epoch_us(h.ts), h.rev, h.mod_idx)) AS since FROM t JOIN {PAST} GROUP BY ALL)"


@query("w16_own", base("SELECT rev, file, mod_idx, me = author AS own FROM (SELECT *, row_number() OVER (PARTITION BY rev, file, mod_idx ORDER BY lines DESC, since) AS k FROM tot) WHERE k = 1", TOTALS))
def w16_own(spark, d):
    return history.with_ownership(A.touches(spark, d)).select(*ID, "own")


@query("w16_minor", base("SELECT rev, file, mod_idx, count(*) FILTER (lines < 0.05 * whole) AS minor FROM (SELECT *, sum(lines) OVER (PARTITION BY rev, file, mod_idx) AS whole FROM tot) GROUP BY ALL", TOTALS))
def w16_minor(spark, d):
    return history.with_minor(A.touches(spark, d)).select(*ID, "minor")


@query(
    "w17_shares",
    base('SELECT t.rev, t.file, t.mod_idx, round(CASE WHEN a > 0 THEN t.added / a ELSE 0 END, 6) AS "add", round(CASE WHEN b > 0 THEN t.removed / b ELSE 0 END, 6) AS del, t.added AS la, t.removed AS ld, t.nloc AS lt FROM t JOIN (SELECT rev, sum(added) AS a, sum(removed) AS b FROM m GROUP BY rev) USING (rev)'),
)
def w17_shares(spark, d):
    """Also W18."""
    t = history.with_commit_shares(history.with_file_measures(A.touches(spark, d)), A.changes(spark, d))
    return t.select(*ID, r("add"), r("del"), "la", "ld", "lt")


@query(
    "w19_previous_inducing",
    base(
        "SELECT t.rev, t.file, t.mod_idx, coalesce(sum((i.rev IS NOT NULL)::INT) OVER (PARTITION BY t.file ORDER BY t.ts, t.rev, t.mod_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS previous_inducing FROM t LEFT JOIN (SELECT DISTINCT rev, file FROM inducing) i ON i.rev = t.rev AND i.file = t.file",
        A.INDUCING,
    ),
)
def w19_previous_inducing(spark, d):
    bad = A.inducing(spark, d).select("rev", "file").distinct()
    return history.previous_inducing(A.touches(spark, d), bad).select(*ID, "previous_inducing")


@query("w20_quality", base(f"SELECT rev, file, mod_idx, sum(fix::INT) OVER (PARTITION BY file ORDER BY ts, rev {SO_FAR})::BIGINT AS quality_urgent, fix AS quality_urgent_commit FROM t"))
def w20_quality(spark, d):
    topics = A.commits(spark, d).select("rev", F.col("fix").alias("urgent"))
    return history.topic_counts(A.touches(spark, d), topics, ["urgent"]).select(*ID, "quality_urgent", "quality_urgent_commit")


DENSITY = """
dens AS (SELECT t.rev, t.file, t.mod_idx, t.ts, CASE WHEN s.system_warnings > 0 AND s.system_lloc > 0 THEN CASE WHEN l.lloc > 0 THEN l.warnings / l.lloc ELSE 0 END - s.system_warnings / s.system_lloc END AS density FROM t JOIN lint l ON l.rev = t.rev AND l.file = t.file JOIN system s ON s.rev = t.rev)"""


def density(spark, d):
    lint = A.lint(spark, d)
    s = linter.system_density(lint).select("rev", "system_WD")
    rows = A.touches(spark, d).join(lint, ["rev", "file"]).join(s, "rev")
    return rows.select(*ID, "ts", F.when(F.col("system_WD") > 0, C.safe_ratio(F.col("warnings"), F.col("lloc")) - F.col("system_WD")).alias("density"))


@query("w21_sum_wd", base("SELECT rev, file, mod_idx, round(coalesce(sum(density) OVER (PARTITION BY file ORDER BY ts, rev, mod_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS file_system_sum_WD FROM dens", A.LINT, DENSITY))
def w21_sum_wd(spark, d):
    return linter.running_density(density(spark, d)).select(*ID, r("file_system_sum_WD"))


@query(
    "w22_decay",
    base(
        "SELECT a.rev, a.file, a.mod_idx, round(coalesce(sum(b.density / (a.k - b.k + 1)), 0) + 1e-9, 6) AS decayed_file_system_sum_WD FROM q a LEFT JOIN q b ON a.file = b.file AND b.k <= a.k AND b.density IS NOT NULL AND b.rid <= a.rid GROUP BY ALL",
        A.LINT,
        DENSITY,
        "q AS (SELECT *, count(density) OVER (PARTITION BY file ORDER BY ts, rev, mod_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, row_number() OVER (PARTITION BY file ORDER BY ts, rev, mod_idx) AS rid FROM dens)",
    ),
)
def w22_decay(spark, d):
    return linter.running_density(density(spark, d)).select(*ID, C.rounded(F.col("decayed_file_system_sum_WD") + 1e-9, 6).alias("decayed_file_system_sum_WD"))  # sums in another order must not meet a tie


DELTA = """
wd AS (SELECT rev, CASE WHEN system_lloc > 0 THEN system_warnings / system_lloc ELSE 0 END AS w FROM system),
delta AS (SELECT p.rev, p.ts, p.author, a.w AS system_WD, coalesce(b.w, 0) AS parent_system_WD, a.w - coalesce(b.w, 0) AS delta_system_WD FROM parent p JOIN wd a ON a.rev = p.rev LEFT JOIN wd b ON b.rev = p.parent)"""


@query("w23_author_delta", base(f"SELECT rev, round(sum(delta_system_WD) OVER (PARTITION BY author ORDER BY ts, rev {SO_FAR}), 6) AS author_delta_sum_WD FROM delta", A.LINT, DELTA))
def w23_author_delta(spark, d):
    p = A.parents(spark, d)
    delta = linter.parent_delta(linter.system_density(A.lint(spark, d)), p)
    return linter.author_delta(p.join(delta, "rev")).select("rev", r("author_delta_sum_WD"))


@query("w24_delta", base("SELECT rev, round(system_WD, 6) AS system_WD, round(parent_system_WD, 6) AS parent_system_WD, round(delta_system_WD, 6) AS delta_system_WD FROM delta", A.LINT, DELTA))
def w24_delta(spark, d):
    return linter.parent_delta(linter.system_density(A.lint(spark, d)), A.parents(spark, d)).select("rev", r("system_WD"), r("parent_system_WD"), r("delta_system_WD"))


@query("w25_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS build_kept FROM events")
def w25_forward_fill(spark, d):
    e = A.table(spark, d, "events").withColumn("build", F.when(F.col("event_type") != "error", F.col("value"))).withColumn("seq", F.struct("ts", "event_id"))
    return builds.kept_state(e, "build", ["user_id"]).select("event_id", "build_kept")


# ---------------------------------------------------------------- aggregates


def commit_query(name: str, sql: str, *cols):
    query(name, base(sql))(lambda spark, d: commits.size_measures(A.changes(spark, d)).select("rev", *(c() if callable(c) else c for c in cols)))


commit_query("a1_commit_sums", "SELECT rev, sum(added)::BIGINT AS kamei_la, sum(removed)::BIGINT AS kamei_ld FROM m GROUP BY rev", "kamei_la", "kamei_ld")
commit_query("a2_ns", "SELECT rev, count(DISTINCT subsystem) AS kamei_ns FROM m GROUP BY rev", "kamei_ns")
commit_query("a3_nd", "SELECT rev, count(DISTINCT directory) AS kamei_nd FROM m GROUP BY rev", "kamei_nd")
commit_query("a4_nf", "SELECT rev, count(*) AS kamei_nf FROM m GROUP BY rev", "kamei_nf")
commit_query("a5_lt", "SELECT rev, (sum(nloc) + sum(removed) - sum(added))::BIGINT AS kamei_lt FROM m GROUP BY rev", "kamei_lt")
commit_query("a6_entropy", "SELECT rev, round(coalesce(sum(CASE WHEN n > 0 THEN -(n / a) * log2(n / a) END), 0), 6) + 0.0 AS kamei_entropy FROM (SELECT rev, added + removed AS n, sum(added + removed) OVER (PARTITION BY rev) AS a FROM m) GROUP BY rev", lambda: (F.round("kamei_entropy", 6) + 0.0).alias("kamei_entropy"))


@query("a7_ndev", base(f"SELECT t.rev, count(DISTINCT h.author) AS kamei_ndev FROM t JOIN {PAST} GROUP BY t.rev"))
def a7_ndev(spark, d):
    return history.reached(A.touches(spark, d), "author").groupBy("rev").agg(F.count("*").alias("kamei_ndev"))


@query("a8_age", SQL["w5_age"].replace("SELECT rev, file, mod_idx, CASE", "SELECT rev, round(avg(CASE").replace("END AS age", "END), 6) AS kamei_age") + " GROUP BY rev")
def a8_age(spark, d):
    t = history.with_file_measures(A.touches(spark, d))
    return t.groupBy("rev").agg(F.round(F.avg("age"), 6).alias("kamei_age"))


@query("a9_nuc", base(f"SELECT t.rev, count(DISTINCT h.rev) AS kamei_nuc FROM t JOIN {PAST} GROUP BY t.rev"))
def a9_nuc(spark, d):
    return history.reached(A.touches(spark, d), "rev").groupBy("rev").agg(F.count("*").alias("kamei_nuc"))


@query(
    "a10_rexp",
    base("SELECT x.rev, round(x.r * k.n, 4) AS kamei_rexp FROM (SELECT a.rev, sum(1.0 / (abs(year(b.ts) - year(a.ts)) + 1)) AS r FROM c a JOIN c b ON a.author = b.author AND (b.ts, b.rev) <= (a.ts, a.rev) GROUP BY a.rev) x JOIN (SELECT rev, count(*) AS n FROM t GROUP BY rev) k USING (rev)"),
)
def a10_rexp(spark, d):
    t = history.with_file_measures(A.touches(spark, d))
    return commits.experience(t, A.commits(spark, d)).select("rev", F.round("kamei_rexp", 4).alias("kamei_rexp"))


@query("a11_sexp", base("SELECT rev, sum(s)::BIGINT AS kamei_sexp FROM (SELECT rev, dense_rank() OVER (PARTITION BY author, subsystem ORDER BY ts, rev) AS s FROM t) GROUP BY rev"))
def a11_sexp(spark, d):
    t = history.with_file_measures(A.touches(spark, d))
    return t.groupBy("rev").agg(F.sum("sexp").alias("kamei_sexp"))


@query("a12_system_wd", base("SELECT rev, system_lloc::BIGINT AS system_lloc, system_warnings::BIGINT AS system_warnings, system_default::BIGINT AS system_default, n_files, round(system_warnings / system_lloc, 6) AS system_WD, round(system_default / system_lloc, 6) AS system_default_WD FROM system", A.LINT))
def a12_system_wd(spark, d):
    s = linter.system_density(A.lint(spark, d))
    return s.select("rev", "system_lloc", "system_warnings", "system_default", "n_files", r("system_WD"), r("system_default_WD"))


@query("a13_warning_counts", "SELECT user_id AS rev, string_agg(event_type || ':' || n::VARCHAR, ',' ORDER BY event_type) AS warnings FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def a13_warning_counts(spark, d):
    e = A.table(spark, d, "events").select(F.col("user_id").alias("rev"), F.lit("f").alias("file"), F.array(F.struct(F.col("event_type").alias("l_ty"))).alias("linter"))
    out = static.warning_counts(e)
    return out.select("rev", F.array_join(F.transform("warnings", lambda w: F.concat(w["rule"], F.lit(":"), w["n"].cast("string"))), ",").alias("warnings"))


@query("a14_density", base("SELECT round(sum(warnings) / sum(lloc), 8) AS density FROM lint WHERE lloc > 0", A.LINT))
def a14_density(spark, d):
    return A.lint(spark, d).where("lloc > 0").agg(F.round(F.sum("warnings") / F.sum("lloc"), 8).alias("density"))


ENTITIES = "ent AS (SELECT user_id AS rev, event_type AS metric, value FROM events)"


def entities(spark, d):
    return A.table(spark, d, "events").select(F.col("user_id").alias("rev"), F.lit("f").alias("file"), F.lit("class").alias("kind"), F.col("event_type").alias("metric"), "value")


@query("a15_system_median", f"WITH {ENTITIES} SELECT rev, metric, round(sum(value), 4) AS sum, round(median(value), 4) AS median FROM ent GROUP BY ALL")
def a15_system_median(spark, d):
    return static.system_metrics(entities(spark, d)).select("rev", "metric", F.round("sum", 4).alias("sum"), F.round("median", 4).alias("median"))


@query("a16_five_aggregates", f"WITH {ENTITIES} SELECT rev, metric, round(sum(value), 4) AS sum, round(avg(value), 8) AS avg, round(median(value), 4) AS median, min(value) AS min, max(value) AS max FROM ent GROUP BY ALL")
def a16_five_aggregates(spark, d):
    return static.five_aggregates(entities(spark, d)).select("rev", "metric", F.round("sum", 4).alias("sum"), F.round("avg", 8).alias("avg"), F.round("median", 4).alias("median"), "min", "max")


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("a18_wide", "SELECT user_id AS rev, " + ", ".join(f"coalesce(round(sum(value) FILTER (event_type = '{k}'), 4), 0) AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def a18_wide(spark, d):
    """Also A17."""
    long = entities(spark, d).groupBy("rev", "file", F.col("metric").alias("name")).agg(F.round(F.sum("value"), 4).alias("value"))
    return static.wide(long, KINDS).drop("file")


@query("a19_validated", base("SELECT DISTINCT rev, file FROM t WHERE fix AND rev NOT IN (SELECT rev FROM m WHERE removed > 5 GROUP BY rev HAVING count(*) > 1)"))
def a19_validated(spark, d):
    m = A.changes(spark, d)
    return labels.validated_fixes(m.where("removed > 5").select("rev", F.col("file").alias("issue_id")), m.where("tracked").select("rev", "file", F.col("fix").alias("verified")))


@query("a20_inducing_sets", base("SELECT rev, count(DISTINCT file) AS files FROM inducing GROUP BY rev", A.INDUCING))
def a20_inducing_sets(spark, d):
    return A.inducing(spark, d).select("rev", "file").distinct().groupBy("rev").agg(F.count("*").alias("files"))


@query("a21_bug_ids", base("SELECT DISTINCT bug_id FROM inducing", A.INDUCING))
def a21_bug_ids(spark, d):
    return A.inducing(spark, d).select("bug_id").distinct()


@query("a24_min_max_by", "SELECT p_brand AS brand, arg_min(p_name, (length(p_name), p_name)) AS shortest, max(p_size) AS largest FROM part GROUP BY p_brand")
def a24_min_max_by(spark, d):
    return A.table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.min_by("p_name", F.struct(F.length("p_name").alias("n"), "p_name")).alias("shortest"), F.max("p_size").alias("largest"))


# ---------------------------------------------------------------- joins and sets


@query("j1_cache_read", "SELECT o_orderkey AS rev, c_name AS project, l_partkey AS path, p_name AS content FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'MACHINERY'")
def j1_cache_read(spark, d):
    o, c, l, p = (A.table(spark, d, n) for n in ("orders", "customer", "lineitem", "part"))
    rows = o.join(c.where("c_mktsegment = 'MACHINERY'"), F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(F.col("o_orderkey").alias("rev"), F.col("c_name").alias("project"), F.col("l_partkey").alias("path"), F.col("p_name").alias("content"))


@query("j2_count_join", "SELECT c_name AS project, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_name")
def j2_count_join(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_name").alias("project")).agg(F.count("*").alias("n"))


@query("j3_left_labels", base("SELECT t.rev, t.file, t.mod_idx, coalesce(string_agg(DISTINCT bug_id, ',' ORDER BY bug_id), '') AS bug_ids FROM t LEFT JOIN inducing i ON i.rev = t.rev AND i.file = t.file GROUP BY ALL", A.INDUCING))
def j3_left_labels(spark, d):
    out = labels.with_labels(A.touches(spark, d), A.inducing(spark, d))
    return out.select(*ID, F.array_join("bug_ids", ",").alias("bug_ids"))


@query("j4_flags", base("SELECT rev, file, mod_idx, rev IN (SELECT rev FROM inducing) AS pascarella_commit, (rev, file) IN (SELECT (rev, file) FROM inducing) AS pascarella_file FROM t", A.INDUCING))
def j4_flags(spark, d):
    return labels.flags(A.touches(spark, d), A.inducing(spark, d)).select(*ID, "pascarella_commit", "pascarella_file")


@query("j5_range", "SELECT e.event_id, f.event_id AS fix_id FROM events e JOIN events f ON f.event_type = 'error' AND f.user_id = e.user_id AND epoch_us(e.ts) BETWEEN epoch_us(f.ts) - 86400000000 AND epoch_us(f.ts)")
def j5_range(spark, d):
    e = A.table(spark, d, "events")
    points = e.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ranges = e.where("event_type = 'error'").select(F.col("event_id").alias("fix_id"), "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) - 86_400_000_000).alias("lo"), F.unix_micros(F.col("ts").cast("timestamp")).alias("hi"))
    return labels.in_range(points, ranges, "at", "lo", "hi", 86_400_000_000.0, ["user_id"]).select("event_id", "fix_id")


@query("j7_neighbours", base("SELECT a.rev, a.file, count(*) AS others FROM t a JOIN t b ON a.rev = b.rev AND a.file <> b.file GROUP BY ALL"))
def j7_neighbours(spark, d):
    n = A.touches(spark, d).groupBy("rev", "file").agg(F.count("*").alias("own"))
    n = n.withColumn("whole", F.sum("own").over(Window.partitionBy("rev"))).where("whole > own")
    return n.select("rev", "file", ((F.col("whole") - F.col("own")) * F.col("own")).alias("others"))


@query(
    "j8_parent_delta",
    base(
        "SELECT coalesce(a.rev, b.rev) AS rev, coalesce(a.subsystem, b.subsystem) AS subsystem, coalesce(a.v, 0) AS current, coalesce(b.v, 0) AS parent, coalesce(a.v, 0) - coalesce(b.v, 0) AS delta FROM v a FULL JOIN (SELECT parent.rev, v.subsystem, v.v FROM parent JOIN v ON v.rev = parent.parent) b ON a.rev = b.rev AND a.subsystem = b.subsystem",
        A.LINT,
        "v AS (SELECT rev, subsystem, sum(added)::DOUBLE AS v FROM t GROUP BY ALL)",
    ),
)
def j8_parent_delta(spark, d):
    long = A.touches(spark, d).groupBy("rev", "subsystem").agg(F.sum("added").cast("double").alias("value"))
    return static.against_parent(long, A.parents(spark, d), ["subsystem"])


@query("j14_prefix", "SELECT url, arg_max(p, length(p)) AS source FROM pages JOIN (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+') AS p FROM pages UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/[^/]+') FROM pages WHERE page_id % 3 = 0) ON p <> '' AND (url = p OR starts_with(url, p || '/')) GROUP BY url")
def j14_prefix(spark, d):
    """Also F31."""
    p = A.table(spark, d, "pages")
    host = p.select(F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("source"))
    first = p.where("page_id % 3 = 0").select(F.regexp_extract("url", "^[a-z]+://[^/]+/[^/]+", 0).alias("source"))
    src = host.union(first).where("source <> ''").distinct().withColumn("value", F.lit(1))
    return builds.by_prefix(p.select(F.col("url").alias("path")).distinct(), src).where("source is not null").select(F.col("path").alias("url"), "source")


@query("j15_needed", base("SELECT rev FROM c WHERE rev IN (SELECT rev FROM t)"))
def j15_needed(spark, d):
    return A.commits(spark, d).join(A.touches(spark, d), "rev", "left_semi").select("rev")


@query("j16_done", base("SELECT rev FROM c WHERE rev NOT IN (SELECT rev FROM m)"))
def j16_done(spark, d):
    return A.commits(spark, d).join(A.changes(spark, d), "rev", "left_anti").select("rev")


@query("j17_as_of", "SELECT l_orderkey AS rev, l_linenumber, l_quantity, l_shipdate, (SELECT max(o2.o_orderdate) FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND o2.o_orderdate <= l_shipdate) AS latest FROM lineitem JOIN orders o ON o_orderkey = l_orderkey")
def j17_as_of(spark, d):
    """The latest order of the customer at each shipment: both in one window instead of a join of all pairs."""
    o = A.table(spark, d, "orders")
    ship = A.table(spark, d, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.col("l_shipdate").alias("at"), F.lit(1).alias("ask"), F.col("l_orderkey").alias("rev"), "l_linenumber", "l_quantity")
    facts = o.select("o_custkey", F.col("o_orderdate").alias("at"), F.lit(0).alias("ask"))
    w = Window.partitionBy("o_custkey").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = ship.unionByName(facts, allowMissingColumns=True).withColumn("latest", F.max(F.when(F.col("ask") == 0, F.col("at"))).over(w))
    return both.where("ask = 1").select("rev", "l_linenumber", "l_quantity", F.col("at").alias("l_shipdate"), "latest")


@query("o1_union", "SELECT path, arg_max(n, side) AS count FROM (SELECT l_partkey AS path, count(*) AS n, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS side FROM lineitem GROUP BY ALL) GROUP BY path")
def o1_union(spark, d):
    """Also G8."""
    s = A.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path"), F.when(F.col("l_returnflag") == "A", 0).otherwise(1).alias("parent_num")).agg(F.count("*").alias("count"))
    return graph.merged_state(s)


@query("o3_intersect", "SELECT l_partkey AS file FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def o3_intersect(spark, d):
    l = A.table(spark, d, "lineitem")
    return l.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("file")).intersect(l.where("l_returnflag = 'R'").select("l_partkey"))


@query("o5_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def o5_distinct(spark, d):
    return A.table(spark, d, "events").select("user_id", "event_type").distinct()


# ---------------------------------------------------------------- scalar functions


PATH = "regexp_replace(url, '^[a-z]+://', '')"


def paths(spark, d):
    return A.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


@query("f5_effective_change", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 2 = 0 THEN 'RENAME' WHEN l_suppkey % 2 = 0 THEN 'DELETE' WHEN l_partkey % 2 = 0 THEN 'ADD' END ELSE CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 2 = 0 THEN l_returnflag END END AS change FROM lineitem")
def f5_effective_change(spark, d):
    l = A.table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "RENAME").otherwise(F.col("l_returnflag"))
    return l.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", C.effective_change(kind, F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 2 == 0).alias("change"))


@query("f6_subsystem", f"SELECT page_id, array_to_string(string_split({PATH}, '/')[:-2], '/') AS subsystem, coalesce(string_split({PATH}, '/')[-2], '/') AS directory FROM pages")
def f6_subsystem(spark, d):
    """Also F7."""
    p = paths(spark, d)
    return p.select("page_id", C.subsystem(F.col("path")).alias("subsystem"), C.directory(F.col("path")).alias("directory"))


@query("f8_name", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS name FROM orders")
def f8_name(spark, d):
    o = A.table(spark, d, "orders")
    return o.select("o_orderkey", C.file_name(F.when(F.col("o_orderstatus") == "F", "DELETE").otherwise("ADD"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("name"))


KEYWORDS = [*BUG_KEYWORDS, "hash"]


@query("f9_keywords", "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{k}')" for k in KEYWORDS) + " AS fix FROM documents")
def f9_keywords(spark, d):
    return A.table(spark, d, "documents").select("doc_id", C.any_substring(F.col("text"), KEYWORDS).alias("fix"))


@query("f10_tokens", "SELECT conv_id, turn, list_has_any(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), ['shall', 'that', 'pour', 'that the']) AS quality FROM conversations")
def f10_tokens(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", C.any_token(F.col("text"), ["shall", "that", "pour", "that the"]).alias("quality"))


@query("f11_code_lines", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^(//|/\\*|\\*|#)'))) AS n FROM documents")
def f11_code_lines(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: C.code_line(x))).cast("long").alias("n"))


@query("f12_size", base("SELECT DISTINCT rev FROM m WHERE n_mods < 5"))
def f12_size(spark, d):
    return A.changes(spark, d).where("n_mods < 5").select("rev").distinct()


@query("f13_date_bound", base(f"SELECT rev, file, mod_idx, comm FROM (SELECT rev, file, mod_idx, ts, count(*) OVER (PARTITION BY file ORDER BY ts, rev {SO_FAR}) AS comm FROM t) WHERE ts <= TIMESTAMP '1998-12-31 23:59:59'"))
def f13_date_bound(spark, d):
    """The bound cuts the output only, not what is counted."""
    t = history.with_file_measures(A.touches(spark, d))
    return t.where(F.col("ts") <= F.lit("1998-12-31 23:59:59").cast("timestamp")).select(*ID, "comm")


@query("f18_issue_keys", "SELECT c_custkey, unnest(regexp_extract_all(replace(c_name, '#', '-') || ' and ' || replace(c_name, '#0', '-'), 'Customer-[0-9]+')) AS key FROM customer")
def f18_issue_keys(spark, d):
    name = F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")), F.lit(" and "), F.replace(F.col("c_name"), F.lit("#0"), F.lit("-")))
    return A.table(spark, d, "customer").select("c_custkey", F.explode(C.issue_keys(name, "Customer")).alias("key"))


@query("f19_majority", "SELECT user_id AS rev, arg_min(event_type, (-n, event_type)) AS key FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def f19_majority(spark, d):
    return labels.majority_key(A.table(spark, d, "events").select(F.col("user_id").alias("rev"), F.col("event_type").alias("key")))


@query("f21_ratio", "SELECT o_orderkey, round(CASE WHEN o_custkey % 7 > 0 THEN o_totalprice / (o_custkey % 7) ELSE 0 END, 4) AS ratio FROM orders")
def f21_ratio(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", F.round(C.safe_ratio(F.col("o_totalprice"), F.col("o_custkey") % 7), 4).alias("ratio"))


@query("f23_year_days", "SELECT l_orderkey, l_linenumber, l_quantity, year(l_shipdate) AS year, floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400)::BIGINT AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def f23_year_days(spark, d):
    """Also F24."""
    l = A.table(spark, d, "lineitem").join(A.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return l.select("l_orderkey", "l_linenumber", "l_quantity", F.year("l_shipdate").cast("long").alias("year"), C.days_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("days"))


@query("f25_default_rules", "SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY user_id")
def f25_default_rules(spark, d):
    w = A.table(spark, d, "events").select("user_id", F.col("event_type").alias("rule"))
    return linter.default_rules(w, ["error", "click"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("f29_build_error", "SELECT doc_id, CASE WHEN contains(text, 'des') THEN 'b' WHEN contains(text, 'the') THEN 'a' ELSE 'unknown' END AS kind FROM documents")
def f29_build_error(spark, d):
    return A.table(spark, d, "documents").select("doc_id", C.build_error(F.col("text"), (("a", "the"), ("b", "des"))).alias("kind"))


# ---------------------------------------------------------------- labels, builds, graph, store


BUGS = [f"bug{i}" for i in range(5)]


@query("l6_bug_matrix", base("SELECT t.rev, t.file, t.mod_idx, " + ", ".join(f"coalesce(max((i.bug_id = '{b}')::INT), 0) AS {b}" for b in BUGS) + " FROM t LEFT JOIN inducing i ON i.rev = t.rev AND i.file = t.file GROUP BY ALL", A.INDUCING))
def l6_bug_matrix(spark, d):
    rows = A.touches(spark, d).select(*ID)
    return labels.bug_matrix(rows, A.inducing(spark, d), BUGS)


@query("g2_reach", "WITH RECURSIVE " + A.SQL + "," + A.LINT + ", go(start, node) AS (SELECT rev, rev FROM parent WHERE parent IS NULL UNION SELECT go.start, p.rev FROM go JOIN parent p ON p.parent = go.node) SELECT DISTINCT node FROM go")
def g2_reach(spark, d):
    p = A.parents(spark, d)
    return graph.reachable(p.where("parent is null").select(F.col("rev").alias("node")), p.where("parent is not null").select("parent", F.col("rev").alias("child")))


@query("g11_possible_renames", base("SELECT a.rev, a.file AS old_path, b.file AS new_path FROM m a JOIN m b ON a.rev = b.rev AND a.subsystem = b.subsystem AND NOT a.tracked AND b.tracked"))
def g11_possible_renames(spark, d):
    m = A.changes(spark, d)
    x = m.select("rev", F.when(F.col("tracked"), "ADD").otherwise("DELETE").alias("kind"), F.concat_ws("/", F.col("file").cast("string"), "subsystem").alias("path"))
    out = graph.possible_renames(x)
    return out.select("rev", *(F.substring_index(c, "/", 1).cast("long").alias(c) for c in ("old_path", "new_path")))


@query("g12_roots", "SELECT DISTINCT o_custkey::VARCHAR AS pom FROM orders WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem)")
def g12_roots(spark, d):
    poms = A.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("pom")).distinct()
    arcs = A.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("child")).distinct().withColumn("parent", F.lit(""))
    return builds.roots(poms, arcs)


@query("k3_content_dedupe", "SELECT event_type AS path, count(DISTINCT props) AS n FROM events GROUP BY event_type")
def k3_content_dedupe(spark, d):
    files = A.table(spark, d, "events").select(F.lit("p").alias("project"), F.col("user_id").cast("string").alias("rev"), F.col("event_type").alias("path"), F.col("props").alias("content"))
    add, _ = store.new_rows(files, spark.createDataFrame([], store.BLOBS), spark.createDataFrame([], store.LINKS))
    return add.groupBy("path").agg(F.count("*").alias("n"))


@query("k2_json_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def k2_json_decode(spark, d):
    return A.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("k7_incremental", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def k7_incremental(spark, d):
    """Half of the events is stored, all are found again: each counts once."""
    e = A.table(spark, d, "events")
    both = store.merged(e.where("event_id % 2 = 0"), e, "event_id")
    return both.groupBy("user_id").agg(F.count("*").alias("n"))


@query("t1_windowed_events", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def t1_windowed_events(spark, d):
    from revlens.streaming.incremental import windowed_counts

    return windowed_counts(A.table(spark, d, "events")).withColumn("total", F.round("total", 2))
