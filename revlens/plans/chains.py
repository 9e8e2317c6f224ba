"""Further queries over the driver's tables: labels by blame, message keys, modes and dates, rule sets, policies, the linter's outputs, static assembly."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.functions import columns as C
from revlens.operators import builds, graph, labels, lineage, linter, static
from revlens.plans import analog as A
from revlens.plans.queries import ID, PATH, base, paths, query

#: Blame of fixes: the touches of a file within 30 days before a fix last changed its lines up to their nloc.
BLAME = """
fixes AS (SELECT rev AS fix, max(ts) AS ts, max(n_mods) AS n_mods FROM t WHERE fix GROUP BY rev),
gone AS (SELECT rev AS fix, file AS old_path, removed AS line FROM t WHERE fix),
blame AS (SELECT DISTINCT f.rev AS fix, f.file AS old_path, t.rev AS inducing, t.file, 0 AS lo, t.nloc AS hi FROM t JOIN t f ON f.fix AND f.file = t.file AND f.rev <> t.rev AND t.ts <= f.ts AND t.ts >= f.ts - INTERVAL 30 DAY),
blamed AS (SELECT DISTINCT fix, inducing, file FROM gone JOIN blame USING (fix, old_path) WHERE line BETWEEN lo AND hi)"""


def fixing(spark, d):
    """(fixes, deleted lines, blame): a commit fixes where its message has a keyword."""
    commits = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("rev"), F.col("o_orderpriority").alias("msg"))
    fix = commits.where(C.any_substring(F.col("msg"), ["urgent"])).select("rev")
    t = A.touches(spark, d).drop("fix")
    own = t.join(fix, "rev")
    fixes = own.groupBy(F.col("rev").alias("fix")).agg(F.max("ts").alias("ts"), F.max("n_mods").alias("n_mods"))
    deleted = own.select(F.col("rev").alias("fix"), F.col("file").alias("old_path"), F.col("removed").alias("line"))
    f = own.select(F.col("rev").alias("fix"), F.col("file").alias("old_path"), F.col("ts").alias("fixed"))
    met = t.join(f, F.col("file") == F.col("old_path")).where("rev <> fix and ts <= fixed and ts >= fixed - interval 30 days")
    return fixes, deleted, met.select("fix", "old_path", F.col("rev").alias("inducing"), "file", F.lit(0).alias("lo"), F.col("nloc").alias("hi")).distinct()


@query("l1_labels", base("SELECT DISTINCT inducing AS rev, file, 'adhoc__' || fix::VARCHAR AS bug_id FROM blamed", BLAME))
def l1_labels(spark, d):
    """Keyword, deleted lines, blame, label."""
    _, deleted, blame = fixing(spark, d)
    return labels.blamed(deleted, blame).select(F.col("inducing").alias("rev"), "file", F.concat(F.lit("adhoc__"), F.col("fix").cast("string")).alias("bug_id")).distinct()


@query("l2_unique_inducing", base("SELECT DISTINCT inducing, file FROM blamed WHERE fix IN (SELECT fix FROM fixes WHERE n_mods < 5 AND ts <= TIMESTAMP '1998-12-31 23:59:59')", BLAME))
def l2_unique_inducing(spark, d):
    return labels.unique_inducing(*fixing(spark, d), most=5, until=F.lit("1998-12-31 23:59:59").cast("timestamp"))


@query("s8_last_modified", base("SELECT fix, file, string_agg(inducing::VARCHAR, ',' ORDER BY inducing) AS commits FROM blamed GROUP BY ALL", BLAME))
def s8_last_modified(spark, d):
    _, deleted, blame = fixing(spark, d)
    return labels.last_modified(deleted, blame).select("fix", "file", F.array_join(F.transform("commits", lambda x: x.cast("string")), ",").alias("commits"))


#: Every touch is a file action; that of a commit is blamed for the first one of the customer's next order, by a label that goes by the subsystem.
CHAIN = """
act AS (SELECT rev * 1000 + mod_idx AS action_id, rev, file, author, fix, mod_idx, subsystem FROM t),
lead_ AS (SELECT rev, min(action_id) AS action_id, any_value(author) AS author, any_value(fix) AS fix FROM act GROUP BY rev),
chain AS (SELECT DISTINCT a.rev, a.file, a.subsystem IN ('Brand#11', 'Brand#12', 'Brand#13') AS valid, f.author % 50 AS who, f.author, f.fix FROM act a JOIN parent p ON p.parent = a.rev JOIN lead_ f ON f.rev = p.rev)"""


def chain(spark, d):
    t = A.touches(spark, d).withColumn("action_id", F.col("rev") * 1000 + F.col("mod_idx"))
    first = t.groupBy("rev").agg(F.min("action_id").alias("first"), F.first("author").alias("author"), F.first("fix").alias("fix"))
    nxt = A.parents(spark, d).where("parent is not null").select(F.col("rev").alias("next"), F.col("parent").alias("rev")).join(first.select(F.col("rev").alias("next"), "first"), "next")
    label = F.when(F.col("subsystem").isin("Brand#11", "Brand#12", "Brand#13"), "JLMIV+R").otherwise("SZZ")
    led = F.array(F.struct(F.col("first").alias("change_file_action_id"), F.lit("suspect").alias("szz_type"), label.alias("label")))
    actions = t.join(nxt, "rev", "left").select("action_id", "rev", "file", F.when(F.col("first").isNotNull(), led).alias("induces"))
    issue = F.concat_ws("_", F.col("author") % 50, F.col("author") % 3)
    commits = first.select("rev", F.when(F.col("fix"), F.array(issue)).alias("fixed_issue_ids"), F.array(issue).alias("linked_issue_ids"))
    issues = first.select(issue.alias("issue_id"), F.when(F.col("author") % 3 != 0, "Bug").otherwise("Task").alias("issue_type"), F.lit("Resolved").alias("status")).distinct().withColumn("issue_type_verified", F.col("issue_type"))
    return actions, commits, issues


ISSUE = "f.who::VARCHAR || '_' || (f.author % 3)::VARCHAR"


@query("j10_issue_chain", base(f"SELECT DISTINCT rev, file, {ISSUE} AS bug_id FROM chain f WHERE author % 3 <> 0", A.LINT, CHAIN))
def j10_issue_chain(spark, d):
    """Also J13: a change is blamed for the next order of the customer, of whose issues (some are no bugs) it takes the ids."""
    return labels.issue_chain(*chain(spark, d), "linked_issue_ids", "issue_type")


@query("l7_dispatch", base(f"SELECT DISTINCT CASE WHEN valid THEN 'JLMIV+R' ELSE 'SZZ' END AS label, rev, file, {ISSUE} AS bug_id FROM chain f WHERE author % 3 <> 0 AND (fix OR NOT valid)", A.LINT, CHAIN))
def l7_dispatch(spark, d):
    """Also L3 and L4: validated labels go by fixed issues, custom ones by linked issues."""
    return labels.label_relation(["JLMIV+R", "SZZ"], *chain(spark, d))


@query("j6_changed_lines", "SELECT w.l_orderkey AS rev, w.l_partkey AS file, w.l_linenumber AS line, w.l_returnflag AS rule, count(*) AS n FROM lineitem w WHERE (w.l_orderkey, w.l_partkey, w.l_linenumber) IN (SELECT (l_orderkey, l_partkey, l_linenumber) FROM lineitem WHERE l_linestatus = 'O') GROUP BY ALL")
def j6_changed_lines(spark, d):
    l = A.table(spark, d, "lineitem")
    key = [F.col("l_orderkey").alias("rev"), F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line")]
    hit = linter.on_changed_lines(l.select(*key, F.col("l_returnflag").alias("rule")), l.where("l_linestatus = 'O'").select(*key))
    return hit.groupBy("rev", "file", "line", "rule").agg(F.count("*").alias("n"))


@query("j11_class_entities", "SELECT p_name AS path, 'CBO' AS metric, sum(l_quantity)::BIGINT AS value, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O' GROUP BY p_name")
def j11_class_entities(spark, d):
    files = A.table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("path"))
    e = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("file_id"), F.when(F.col("l_linestatus") == "O", "class").otherwise("method").alias("kind"), F.lit("CBO").alias("metric"), F.col("l_quantity").alias("value"))
    return static.of_classes(files, e).groupBy("path", "metric").agg(F.sum("value").cast("long").alias("value"), F.count("*").alias("n"))


MSG = "replace(c_name, '#', '-') || ' and ' || replace(c_name, '#0', '-')"


@query("j12_message_issues", f"SELECT c.c_custkey AS rev, i.external_id, i.issue_id FROM (SELECT c_custkey, unnest(list_distinct(regexp_extract_all({MSG}, 'Customer-[0-9]+'))) AS external_id FROM customer) c JOIN (SELECT replace(c_name, '#', '-') AS external_id, c_nationkey AS issue_id FROM customer) i USING (external_id)")
def j12_message_issues(spark, d):
    c = A.table(spark, d, "customer")
    msg = F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")), F.lit(" and "), F.replace(F.col("c_name"), F.lit("#0"), F.lit("-")))
    issues = c.select(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")).alias("external_id"), F.col("c_nationkey").alias("issue_id"))
    return labels.message_issues(c.select(F.col("c_custkey").alias("rev"), msg.alias("msg")), issues, "Customer").select("rev", "external_id", "issue_id")


@query("f16_before_report", "SELECT l_orderkey AS rev, l_partkey AS file, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY ALL")
def f16_before_report(spark, d):
    s = A.table(spark, d, "lineitem").join(A.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = s.select(F.col("l_orderkey").alias("rev"), F.col("l_partkey").alias("file"), F.col("l_shipdate").alias("inducing_ts"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("created_at"))
    return labels.before_report(s).groupBy("rev", "file").agg(F.count("*").alias("n"))


@query("f17_modes", "SELECT l_partkey AS file, count(*) AS n FROM lineitem WHERE lower(l_returnflag) NOT IN ('c', 'r') GROUP BY ALL")
def f17_modes(spark, d):
    a = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_returnflag").alias("mode"))
    return labels.changed_modes(a).groupBy("file").agg(F.count("*").alias("n"))


HUNK = """h AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(replace(replace(text, 'e', chr(10) || '+'), 'a', chr(10) || '-'), chr(10)) AS ls FROM documents)),
x AS (SELECT doc_id, k - 1 AS no, line[1] AS sign, (coalesce(sum((NOT starts_with(line, '+'))::INT) OVER w, 0))::BIGINT AS old, (coalesce(sum((NOT starts_with(line, '-'))::INT) OVER w, 0))::BIGINT AS new FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def hunks(spark, d):
    """Texts as hunks: what follows an e is added, what follows an a deleted. doc_id is unique."""
    text = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("\n+")), F.lit("a"), F.lit("\n-"))
    return A.table(spark, d, "documents").select("doc_id", text.alias("content"))


@query("f20_hunk_lines", f"WITH {HUNK} SELECT doc_id, no, old, new FROM x")
def f20_hunk_lines(spark, d):
    """How many old and new lines stand before each line of a hunk."""
    x = labels.hunk_lines(hunks(spark, d), ["doc_id"], text=False)
    return x.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("no", "old", "new")))


@query("f20_changed_lines", f"WITH {HUNK} SELECT doc_id, kind, count(*) AS n, sum(line)::BIGINT AS lines FROM (SELECT doc_id, 'added' AS kind, 10 + new AS line FROM x WHERE sign = '+' UNION ALL SELECT doc_id, 'deleted', 20 + old FROM x WHERE sign = '-' UNION ALL SELECT doc_id, 'verified', 20 + old FROM x WHERE sign = '-' AND no % 3 = 1) GROUP BY ALL")
def f20_changed_lines(spark, d):
    x = labels.hunk_lines(hunks(spark, d), ["doc_id"], text=False).withColumn("old_start", F.lit(20)).withColumn("new_start", F.lit(10))
    out = labels.changed_lines(x, ["doc_id"], "old_start", "new_start", x.where("no % 3 = 1").select("doc_id", "no"))
    return out.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("line").cast("long").alias("lines"))


@query("f26_effective_rules", "SELECT user_id % 50 AS source_dir, event_type AS rule, count(*) AS n FROM events WHERE (user_id % 50, event_type) IN (SELECT (user_id % 50, event_type) FROM events WHERE value > 90) GROUP BY ALL")
def f26_effective_rules(spark, d):
    e = A.table(spark, d, "events").select((F.col("user_id") % 50).alias("source_dir"), F.col("event_type").alias("rule"), "value")
    return linter.effective_rules(e, e.where("value > 90").select("source_dir", "rule")).groupBy("source_dir", "rule").agg(F.count("*").alias("n"))


@query("o4_rule_sets", "SELECT user_id AS ident, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM (SELECT DISTINCT user_id, event_type FROM events) u JOIN (SELECT DISTINCT event_type, (user_id % 10)::VARCHAR AS rule FROM events) s ON s.event_type = u.event_type AND rule <> '1' GROUP BY user_id")
def o4_rule_sets(spark, d):
    """Each user refers to whole sets, less one rule."""
    e = A.table(spark, d, "events")
    refs = e.select(F.col("user_id").alias("ident"), F.concat(F.lit("category/"), "event_type", F.lit(".xml")).alias("ref")).distinct().withColumn("excluded", F.array(F.lit("1")))
    sets = e.groupBy(F.col("event_type").alias("ruleset")).agg(F.collect_set((F.col("user_id") % 10).cast("string")).alias("rules"))
    return builds.expanded_rules(refs, sets).select("ident", F.array_join("rules", ",").alias("rules"))


FORKED = f"CASE page_id % 3 WHEN 0 THEN {PATH} || '/tests/x.py' WHEN 1 THEN {PATH} || '.PY' ELSE {PATH} || '/test/x.java' END"


@query("f2_python_filter", f"SELECT page_id, ends_with(lower(p), '.py') AND NOT contains(lower(p), '/test/') AND NOT contains(lower(p), '/tests/') AS python, ends_with(lower(p), '.py') AS all_python, ends_with(lower(p), '.java') AND NOT regexp_matches(lower(p), '(^|/)(test|tests|examples?)/') AS java, ends_with(lower(p), '.java') AS all_java, false AS other FROM (SELECT page_id, {FORKED} AS p FROM pages)")
def f2_python_filter(spark, d):
    """Also F1, F3 and F4 (unknown languages track nothing)."""
    p = paths(spark, d).select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat("path", F.lit("/tests/x.py"))).when(F.col("page_id") % 3 == 1, F.concat("path", F.lit(".PY"))).otherwise(F.concat("path", F.lit("/test/x.java"))).alias("p"))
    kinds = {"python": ("python", True), "all_python": ("python", False), "java": ("java", True), "all_java": ("java", False), "other": ("cobol", True)}
    return p.select("page_id", *(C.language_file(lang, F.col("p"), only).alias(n) for n, (lang, only) in kinds.items()))


@query("o2_except", "SELECT path, 'files' AS side FROM (SELECT DISTINCT o_custkey AS path FROM orders EXCEPT SELECT DISTINCT l_partkey FROM lineitem) UNION ALL SELECT path, 'state' FROM (SELECT DISTINCT l_partkey AS path FROM lineitem EXCEPT SELECT DISTINCT o_custkey FROM orders)")
def o2_except(spark, d):
    """Also G9."""
    files = A.table(spark, d, "orders").select(F.col("o_custkey").alias("path")).distinct()
    return graph.state_check(files, A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("path")).distinct())


@query("o7_reverse", "SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts DESC, event_id DESC) AS path FROM events GROUP BY user_id")
def o7_reverse(spark, d):
    """A path from its tip back."""
    e = A.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("p"))
    return e.select("user_id", F.array_join(F.reverse(F.transform("p", lambda x: x["event_id"].cast("string"))), ",").alias("path"))


KIND = "CASE WHEN NOT tracked THEN 'DELETE' WHEN added % 2 = 0 THEN 'ADD' ELSE 'MODIFY' END"
STATE = f"s AS (SELECT file AS path, (ts, rev, mod_idx) AS seq, rev, {KIND} AS kind FROM m)"


def states(spark, d):
    m = A.changes(spark, d)
    kind = F.when(~F.col("tracked"), "DELETE").when(F.col("added") % 2 == 0, "ADD").otherwise("MODIFY")
    return m.select(F.col("file").alias("path"), F.struct("ts", "rev", "mod_idx").alias("seq"), "rev", "mod_idx", kind.alias("kind"))


@query("g7_file_state", base("SELECT path, last.rev AS rev, last.kind AS kind FROM (SELECT path, arg_max({'rev': rev, 'kind': kind}, seq) AS last FROM s GROUP BY path) WHERE last.kind <> 'DELETE'", STATE))
def g7_file_state(spark, d):
    """Files that exist at the end."""
    return graph.file_state(states(spark, d)).where("kind <> 'DELETE'")


@query("g7_broken", base("SELECT path, rev, kind FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY path ORDER BY seq) <> 'DELETE', false) AS there FROM s) WHERE (kind = 'ADD') = there", STATE))
def g7_broken(spark, d):
    """Changes that can't be: adding what exists, touching what doesn't."""
    return graph.broken_states(states(spark, d)).select("path", "rev", "kind")


@query("g6_order", base("SELECT rev, row_number() OVER (ORDER BY ts, rev) AS place FROM c"))
def g6_order(spark, d):
    """The order of a project's commits, its customers' chains being the graph."""
    p = A.parents(spark, d).select("rev", F.when(F.col("parent").isNull(), F.array().cast("array<long>")).otherwise(F.array("parent")).alias("parents"), F.col("ts").alias("date"), F.col("rev").alias("place"))
    return lineage.ordered(p).select("rev", (F.col("seq") + 1).alias("place"))


# ---------------------------------------------------------------- builds


def build_rows(spark, d):
    error = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, "parse").otherwise("unknown"))
    return A.table(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("seq"), (F.col("event_type") != "view").alias("touched"), error.alias("error"), F.col("value").alias("info"))


@query("f30_policy", "SELECT event_id, last_value(CASE WHEN event_type NOT IN ('view', 'error') THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS info_kept, coalesce(event_type = 'error' AND NOT value > 50, false) AS failed FROM events")
def f30_policy(spark, d):
    return builds.with_policy(build_rows(spark, d), ["user_id"]).select("event_id", "info_kept", F.coalesce("failed", F.lit(False)).alias("failed"))


@query("k9_build_memo", "SELECT user_id AS rev, coalesce(max(CASE WHEN event_type <> 'error' THEN event_type END), '{}') AS info FROM events GROUP BY user_id")
def k9_build_memo(spark, d):
    e = A.table(spark, d, "events")
    return builds.memo(e.select(F.col("user_id").alias("rev"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("info")))


@query("f29_error_line", "SELECT doc_id, CASE WHEN contains(text, 'des') THEN list_filter(string_split(text, chr(10)), lambda x: contains(x, 'des'))[-1] WHEN contains(text, 'the') THEN list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the'))[-1] END AS line FROM documents")
def f29_error_line(spark, d):
    return A.table(spark, d, "documents").select("doc_id", builds.error_line(F.col("text"), (("a", "the"), ("b", "des"))).alias("line"))


@query("f28_parent_rewrite", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, CASE WHEN l_suppkey % 5 = 0 AND l_returnflag = 'A' THEN 'new' WHEN l_linestatus = 'O' THEN regexp_replace(l_returnflag || '-SNAPSHOT', '-SNAPSHOT$', '') ELSE l_returnflag || '-SNAPSHOT' END AS version FROM lineitem")
def f28_parent_rewrite(spark, d):
    l = A.table(spark, d, "lineitem")
    poms = l.select(F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").alias("pom"), F.col("l_returnflag").alias("group"), (F.col("l_suppkey") % 5).cast("string").alias("artifact"), F.concat("l_returnflag", F.lit("-SNAPSHOT")).alias("version"), F.when(F.col("l_linestatus") != "O", "..").alias("relative"))
    rules = l.select(F.lit("A").alias("group"), F.lit("0").alias("artifact"), F.concat("l_returnflag", F.lit("-SNAPSHOT")).alias("version"), F.lit("new").alias("new_version")).distinct()
    return builds.rewritten_parents(poms, rules).select("pom.*", "version")


@query("g13_doubles", "SELECT pom, ident FROM (SELECT DISTINCT event_type AS pom, user_id % 40 AS ident FROM events) WHERE pom NOT IN (SELECT i.pom FROM (SELECT DISTINCT event_type AS pom, user_id % 40 AS ident FROM events) i JOIN (SELECT ident, arg_min(pom, (length(pom), pom)) AS best FROM (SELECT DISTINCT event_type AS pom, user_id % 40 AS ident FROM events) GROUP BY ident HAVING count(*) > 1) b ON b.ident = i.ident AND i.pom <> b.best)")
def g13_doubles(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_type").alias("pom"), (F.col("user_id") % 40).alias("ident")).distinct()
    return builds.without_doubles(e)


# ---------------------------------------------------------------- static metrics, the linter's outputs


@query("k8_precache", base("SELECT rev, file, sum(added)::BIGINT AS added FROM t WHERE rev IN (SELECT rev FROM parent WHERE fix UNION SELECT parent FROM parent WHERE fix AND parent IS NOT NULL) GROUP BY ALL", A.LINT))
def k8_precache(spark, d):
    p = A.parents(spark, d).where("fix").select("rev", "parent")
    return static.needed_metrics(A.touches(spark, d), p).groupBy("rev", "file").agg(F.sum("added").cast("long").alias("added"))


@query(
    "a18_assembly",
    base(
        "SELECT rev, subsystem, p || name AS name, CASE p WHEN 'current_' THEN a WHEN 'parent_' THEN b ELSE a - b END AS value FROM (SELECT coalesce(x.rev, y.rev) AS rev, coalesce(x.subsystem, y.subsystem) AS subsystem, coalesce(x.name, y.name) AS name, coalesce(x.v, 0) AS a, coalesce(y.v, 0) AS b FROM v x FULL JOIN (SELECT parent.rev, subsystem, name, v FROM parent JOIN v ON v.rev = parent.parent) y ON x.rev = y.rev AND x.subsystem = y.subsystem AND x.name = y.name), (VALUES ('current_'), ('parent_'), ('delta_')) q(p)",
        A.LINT,
        "v AS (SELECT rev, subsystem, 'LOC_sum' AS name, sum(added)::DOUBLE AS v FROM t GROUP BY ALL UNION ALL SELECT rev, subsystem, 'LOC_max', max(nloc)::DOUBLE FROM t GROUP BY ALL)",
    ),
)
def a18_assembly(spark, d):
    """Long form of the wide features: current, parent, delta of each."""
    g = A.touches(spark, d).groupBy("rev", "subsystem").agg(F.sum("added").cast("double").alias("s"), F.max("nloc").cast("double").alias("m"))
    long = g.select("rev", "subsystem", F.explode(F.array(F.struct(F.lit("LOC_sum").alias("name"), F.col("s").alias("value")), F.struct(F.lit("LOC_max").alias("name"), F.col("m").alias("value")))).alias("x")).select("rev", "subsystem", "x.*")
    return static.assembled(long, A.parents(spark, d), ["subsystem"])


#: Touches as states of code entities: the line number tells the kind, the part's brand is the file, the flag of returns a rule.
STATES = """
st AS (SELECT l_orderkey AS rev, p_brand AS file, ['file', 'class', 'method', 'interface', 'enum', 'other', 'class'][l_linenumber] AS kind, l_quantity::DOUBLE AS loc, l_linenumber::DOUBLE AS lloc, l_returnflag AS rule FROM lineitem JOIN part ON p_partkey = l_partkey),
un AS (SELECT rev, file, kind, metric, CASE metric WHEN 'LOC' THEN loc ELSE lloc END AS value FROM st, (VALUES ('LOC'), ('LLOC')) q(metric)),
below AS (SELECT rev, file, metric || '_' || kind AS stem, sum(value) AS s, avg(value) AS a, median(value) AS m, min(value) AS l, max(value) AS h FROM un WHERE kind IN ('class', 'method', 'interface', 'enum') GROUP BY ALL),
own AS (SELECT rev, file, metric, max(value) AS value FROM un WHERE kind = 'file' GROUP BY ALL),
warned AS (SELECT rev, file, rule, count(*)::DOUBLE AS n FROM st WHERE kind = 'file' AND rule IN ('A', 'R') GROUP BY ALL),
plain AS (SELECT rev, file, stem || '_sum' AS name, s AS value FROM below UNION ALL SELECT rev, file, stem || '_avg', a FROM below UNION ALL SELECT rev, file, stem || '_median', m FROM below UNION ALL SELECT rev, file, stem || '_min', l FROM below
  UNION ALL SELECT rev, file, stem || '_max', h FROM below UNION ALL SELECT rev, file, metric || '_file', value FROM own UNION ALL SELECT rev, file, rule, n FROM warned
  UNION ALL SELECT o.rev, o.file, 'sm_WD', coalesce((SELECT sum(n) FROM warned w WHERE w.rev = o.rev AND w.file = o.file), 0) / o.value FROM own o WHERE metric = 'LLOC' AND value > 0),
sides AS (SELECT coalesce(x.rev, y.rev) AS rev, coalesce(x.file, y.file) AS file, coalesce(x.name, y.name) AS name, coalesce(x.value, 0) AS a, coalesce(y.value, 0) AS b
  FROM plain x FULL JOIN (SELECT parent.rev, file, name, value FROM parent JOIN plain ON plain.rev = parent.parent) y ON x.rev = y.rev AND x.file = y.file AND x.name = y.name),
three AS (SELECT rev, file, CASE WHEN name = 'sm_WD' THEN ['sm_current_WD', 'sm_parent_WD', 'delta_WD'][k] ELSE ['current_', 'parent_', 'delta_'][k] || name END AS name, [a, b, a - b][k] AS value FROM sides, range(1, 4) r(k))"""


SHOWN_FEATURES = [f"{side}_{name}" for name in (*(f"LOC_class_{a}" for a in static.FIVE), "LLOC_method_sum", "LOC_file", "LLOC_file", "A", "R") for side in static.SIDES] + ["sm_current_WD", "sm_parent_WD", "delta_WD", "lt"]


@query("a18_features", base("SELECT rev, file, " + ", ".join(f"round(coalesce(max(value) FILTER (name = '{n}'), 0), 6) AS \"{n}\"" for n in SHOWN_FEATURES) + " FROM (SELECT * FROM three UNION ALL SELECT rev, file, 'lt', value FROM three WHERE name = 'parent_LOC_file') GROUP BY rev, file", A.LINT, STATES))
def a18_features(spark, d):
    """The chain of static features: unfolded metrics, five aggregates, warnings by rule, densities, the parent's side and the differences, some of them as columns. Also A13, A16, A17, J8."""
    kinds = F.array(*(F.lit(k) for k in ("file", "class", "method", "interface", "enum", "other", "class")))
    l = A.table(spark, d, "lineitem").join(A.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file")), "l_partkey")
    metrics = F.create_map(F.lit("LOC"), F.col("l_quantity").cast("double"), F.lit("LLOC"), F.col("l_linenumber").cast("double"), F.lit("unknown"), F.lit(1.0))
    states = l.select(F.col("l_orderkey").alias("rev"), "file", kinds[F.col("l_linenumber").cast("int") - 1].alias("kind"), metrics.alias("metrics"), F.array(F.struct(F.col("l_returnflag").alias("l_ty"))).alias("linter"))
    wide = static.wide_features(states, A.parents(spark, d), ["A", "R"], SHOWN_FEATURES)
    return wide.select("rev", "file", *(C.rounded(F.col(n), 6).alias(n) for n in SHOWN_FEATURES))


ROWS = """
l AS (SELECT rev, file, sum(removed) AS warnings, sum(CASE WHEN nloc <= 3 THEN removed ELSE 0 END) AS default_warnings, sum(CASE WHEN nloc <= 2 THEN removed ELSE 0 END) AS effective_warnings, sum(nloc * 10) AS lloc FROM t WHERE added % 5 <> 0 GROUP BY ALL),
pa AS (SELECT *, lag(rev) OVER (PARTITION BY author ORDER BY ts, rev) AS parent FROM c),
s0 AS (SELECT pa.rev, any_value(pa.ts) AS ts, any_value(pa.author) AS author, any_value(pa.parent) AS parent, coalesce(sum(lloc), 0) AS lloc, count(l.rev) AS n, coalesce(sum(warnings), 0) AS w, coalesce(sum(default_warnings), 0) AS dw, coalesce(sum(effective_warnings), 0) AS ew FROM pa LEFT JOIN l USING (rev) GROUP BY pa.rev),
s1 AS (SELECT *, CASE WHEN lloc > 0 THEN w / lloc ELSE 0 END AS wd, CASE WHEN lloc > 0 THEN dw / lloc ELSE 0 END AS dwd, CASE WHEN lloc > 0 THEN ew / lloc ELSE 0 END AS ewd FROM s0),
s2 AS (SELECT a.*, b.w AS pw, coalesce(b.wd, 0) AS pwd, coalesce(b.dwd, 0) AS pdwd, coalesce(b.ewd, 0) AS pewd FROM s1 a LEFT JOIN s1 b ON b.rev = a.parent),
s3 AS (SELECT *, list(wd - pwd) OVER o AS xs, list(dwd - pdwd) FILTER (parent IS NOT NULL) OVER o AS dxs, list(ewd - pewd) FILTER (parent IS NOT NULL) OVER o AS exs FROM s2 WINDOW o AS (PARTITION BY author ORDER BY ts, rev)),
r0 AS (SELECT t.rev, t.file, t.mod_idx, t.ts, s3.* EXCLUDE (rev, ts, lloc), s3.lloc AS sys_lloc, l.warnings, coalesce(CASE WHEN l.lloc > 0 THEN l.warnings / l.lloc END, 0) AS cwd, coalesce(CASE WHEN l.lloc > 0 THEN l.default_warnings / l.lloc END, 0) AS cdwd, coalesce(CASE WHEN l.lloc > 0 THEN l.effective_warnings / l.lloc END, 0) AS cewd,
  q.warnings AS qw, CASE WHEN q.lloc > 0 THEN q.warnings / q.lloc END AS qwd, CASE WHEN q.lloc > 0 THEN q.default_warnings / q.lloc END AS qdwd FROM t JOIN s3 ON s3.rev = t.rev LEFT JOIN l ON l.rev = t.rev AND l.file = t.file LEFT JOIN l q ON q.rev = s3.parent AND q.file = t.file),
r1 AS (SELECT *, list(cwd - wd) FILTER (wd <> 0) OVER o AS fs, list(cdwd - dwd) FILTER (wd <> 0) OVER o AS dfs, list(cewd - ewd) FILTER (wd <> 0) OVER o AS efs FROM r0 WINDOW o AS (PARTITION BY file ORDER BY ts, rev, mod_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def dec(xs: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, len({xs}) + 1), lambda i: {xs}[len({xs}) - i + 1] / i)), 0)"


SHOWN = {"file_system_sum_WD": "list_sum(fs)", "file_system_sum_default_WD": "list_sum(dfs)", "decayed_file_system_sum_WD": dec("fs"), "decayed_file_system_sum_default_WD": dec("dfs"), "decayed_file_system_sum_effective_WD": dec("efs"), "author_delta_sum_WD": "list_sum(xs)", "author_delta_sum_default_WD": "coalesce(list_sum(dxs), 0)", "decayed_author_delta_sum_WD": dec("xs"), "decayed_author_delta_sum_default_WD": dec("dxs"), "decayed_author_delta_sum_effective_WD": dec("exs")}
VALUES = {
    "linter_warnings": "coalesce(warnings, 'inf'::DOUBLE)::DOUBLE", "linter_parent_warnings": "CASE WHEN pwd <> 0 THEN coalesce(qw, 0) ELSE 0 END::BIGINT", "linter_lloc": "sys_lloc::BIGINT", "linter_files": "n", "current_WD": "cwd", "current_default_WD": "cdwd", "current_effective_WD": "cewd",
    "parent_system_default_WD": "pdwd", "current_system_warning_sum": "w::BIGINT", "parent_WD": "CASE WHEN pwd <> 0 THEN coalesce(qwd, 0) ELSE 0 END", "parent_system_WD": "pwd", "parent_default_WD": "CASE WHEN pwd <> 0 THEN coalesce(qdwd, 0) ELSE 0 END", "parent_system_warning_sum": "CASE WHEN pwd <> 0 THEN coalesce(pw, 0) ELSE 0 END::BIGINT",
    "delta_system_WD": "wd - pwd", "delta_system_default_WD": "dwd - pdwd", "current_system_WD": "wd", "system_WD": "wd", "current_system_default_WD": "dwd", "effective_system_WD": "ewd", "parent_effective_system_WD": "pewd", "delta_effective_system_WD": "ewd - pewd",
}
WHOLE = ("linter_parent_warnings", "linter_lloc", "linter_files", "current_system_warning_sum", "parent_system_warning_sum", "linter_warnings")


def digits(v: str, n: str) -> str:
    return f"{v} AS {n}" if n in WHOLE else f"round({v} + 1e-9, 6) AS {n}"  # sums in another order must not meet a tie


@query("n1_linter_rows", base("SELECT rev, file, mod_idx, " + ", ".join([*(digits(v, n) for n, v in VALUES.items()), *(f"round(CASE WHEN wd <> 0 THEN {v} END + 1e-9, 6) AS {n}" for n, v in SHOWN.items())]) + " FROM r1", ROWS))
def n1_linter_rows(spark, d):
    """The linter's row outputs (section 2.8 of the survey) with all running sums; also W21 to W24 in their default and effective forms."""
    t = A.touches(spark, d)
    lint = t.where("added % 5 <> 0").groupBy("rev", "file").agg(F.sum("removed").alias("warnings"), F.sum(F.when(F.col("nloc") <= 3, F.col("removed")).otherwise(0)).alias("default_warnings"), F.sum(F.when(F.col("nloc") <= 2, F.col("removed")).otherwise(0)).alias("effective_warnings"), F.sum(F.col("nloc") * 10).alias("lloc"))
    out = linter.row_outputs(t, lint, A.parents(spark, d))
    return out.select(*(F.col(c) if c in (*WHOLE, *ID) else C.rounded(F.col(c) + 1e-9, 6).alias(c) for c in out.columns))
