"""Sources, graph, builds, stores, streaming."""

import os
import subprocess
import sys
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.functions import columns as C
from revlens.operators import builds, graph, labels, lineage, linter, store
from revlens.sources import files, git
from revlens.streaming import incremental


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")

    def run(*args, when="2018-01-01T01:00:00+0200", who="test"):
        env = os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": who, "GIT_COMMITTER_NAME": who, "GIT_AUTHOR_EMAIL": f"{who}@test.local", "GIT_COMMITTER_EMAIL": f"{who}@test.local"}
        subprocess.run(["git", "-C", str(at), *args], check=True, capture_output=True, env=env)

    run("init", "-q", "-b", "master")
    (at / "Main.java").write_text("a\nb\nc\nd\ne\nf\n")
    run("add", ".")
    run("commit", "-qm", "a")
    (at / "Main.java").write_text("a\nb\nc\nd\ne\nf\ng\n")
    run("commit", "-qam", "b", when="2018-01-03T01:00:00+0200", who="test2")
    run("mv", "Main.java", "Rubbish.java")
    run("commit", "-qam", "c", when="2018-01-04T01:00:00+0200")
    (at / "Rubbish.java").write_text("a\nb\nX\nd\ne\nf\n")
    run("commit", "-qam", "fix d", when="2018-01-05T01:00:00+0200")
    return str(at)


def test_git(spark, repo):
    git.register(spark)
    read = lambda table, **kw: spark.read.format("revlens_git").options(path=repo, table=table, per="2", **kw).load()
    c = read("commits").orderBy("committer_ts").collect()
    assert [r["msg"] for r in c] == ["a", "b", "c", "fix d"] and c[1]["parents"] == [c[0]["rev"]]
    assert c[0]["tz_offset_min"] == 120 and c[0]["committer_local"] == datetime(2018, 1, 1, 1) and c[1]["author"] == "test2@test.local"
    m = {r["rev"]: r for r in read("modifications").collect()}
    kinds = [(m[r["rev"]]["change_type"], m[r["rev"]]["added"], m[r["rev"]]["removed"]) for r in c]
    assert kinds == [("ADD", 6, 0), ("MODIFY", 1, 0), ("RENAME", 0, 0), ("MODIFY", 1, 2)]
    assert (m[c[2]["rev"]]["old_path"], m[c[2]["rev"]]["new_path"]) == ("Main.java", "Rubbish.java")
    assert [r["path"] for r in read("files", rev="HEAD").collect()] == ["Rubbish.java"] and read("refs").count() == 1
    b = read("blame", rev=c[2]["rev"], file="Rubbish.java").collect()
    assert {(r["inducing"], r["file"], r["lo"], r["hi"]) for r in b} == {(c[0]["rev"], "Main.java", 1, 6), (c[1]["rev"], "Main.java", 7, 7)}


def test_order_prefers_parents_then_dates(spark):
    def order(nodes, links):
        rows = [(n, [p for p, c in links if c == n], d, k) for k, (n, d) in enumerate(nodes)]
        return [r["rev"] for r in lineage.ordered(spark.createDataFrame(rows, "rev string, parents array<string>, date int, place int")).orderBy("seq").collect()]

    assert order([("a", 1), ("b", 3), ("c", 2)], [("a", "b"), ("b", "c")]) == ["a", "b", "c"]
    assert order([("a", 1), ("b", 3), ("c", 2)], [("a", "b"), ("a", "c")]) == ["a", "c", "b"]
    with pytest.raises(ValueError):
        order([("a", 1), ("b", 2)], [("a", "b"), ("b", "a")])
    paths = graph.path_cover("a", {"a": ["b", "x"], "b": ["m"], "x": ["m"], "m": ["z"]})
    arcs = sorted((p, q) for path in paths for p, q in zip(path, path[1:]))
    assert arcs == [("a", "b"), ("a", "x"), ("b", "m"), ("m", "z"), ("x", "m")]
    assert len(graph.path_key(["a"])) == 40


def test_states(spark):
    ch = spark.createDataFrame([("A", 1, "r1", "ADD"), ("A", 2, "r2", "DELETE"), ("B", 1, "r1", "ADD"), ("B", 3, "r3", "ADD"), ("C", 2, "r2", "MODIFY")], "path string, seq int, rev string, kind string")
    assert {(r["path"], r["rev"]) for r in graph.broken_states(ch).collect()} == {("B", "r3"), ("C", "r2")}
    ren = spark.createDataFrame([(1, "a", "b"), (2, "b", "c")], "at int, old_path string, new_path string")
    assert {r["path"]: r["oldest"] for r in lineage.oldest_names(ren).collect()} == {"b": "a", "c": "a"}


def test_columns(spark):
    d = spark.createDataFrame([("src/a/B.py", "Fix it\nsigned-off by pmd"), ("x/tests/B.py", "use pmd now"), ("B.java", None)], "p string, m string")
    got = d.select(C.python_file(F.col("p")).alias("py"), C.subsystem(F.col("p")).alias("s"), C.directory(F.col("p")).alias("d"), C.any_substring(F.col("m"), ["fix"]).alias("f"), C.any_token(F.col("m"), ["pmd"]).alias("t")).collect()
    assert [tuple(r) for r in got] == [(True, "src/a", "a", True, False), (False, "x/tests", "tests", False, True), (False, "", "/", False, False)]
    h = labels.hunk_lines(spark.createDataFrame([(1, " a\n-b\r\n+c\n d")], "id int, content string"), ["id"]).orderBy("no").collect()
    assert [(x["sign"], x["text"], x["old"], x["new"]) for x in h] == [(" ", "a", 0, 0), ("-", "b", 1, 1), ("+", "c", 2, 1), (" ", "d", 2, 2)]
    e = spark.createDataFrame([("x Malformed POM y Child module z",), ("fine",)], "o string").select(C.build_error(F.col("o")).alias("e")).collect()
    assert [r["e"] for r in e] == ["child", "unknown"]
    neg = spark.createDataFrame([(datetime(2020, 1, 1, 0), datetime(2020, 1, 1, 22))], "a timestamp, b timestamp").select(C.days_between(F.col("a"), F.col("b")).alias("n")).first()["n"]
    assert neg == -1


POM = """<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>g</groupId><artifactId>root</artifactId><version>1</version></parent>
<artifactId>m</artifactId><modules><module>x</module></modules><build><sourceDirectory>src/java</sourceDirectory><plugins><plugin><artifactId>maven-pmd-plugin</artifactId>
<configuration><rulesets><ruleset>own.xml</ruleset></rulesets></configuration></plugin></plugins></build></project>"""


def test_builds(spark, tmp_path):
    p = files.build_files(spark.createDataFrame([("pom.xml", POM)], "pom string, xml string")).first()
    assert (p["ident"], p["parent"], p["modules"], p["source_directory"], p["use_pmd"], p["use_checkstyle"], p["rulesets"]) == ("g:m-1", "g:root-1", ["x"], "src/java", True, False, ["own.xml"])
    refs = files.rule_refs(spark.createDataFrame([("i", '<ruleset><rule ref="category/java/basic.xml"><exclude name="B"/></rule><rule ref="x/y/Own"/><rule name="no"/></ruleset>')], "ident string, xml string"))
    sets = spark.createDataFrame([("basic", ["A", "B", "C"])], "ruleset string, rules array<string>")
    assert builds.expanded_rules(refs, sets).first()["rules"] == ["A", "C", "Own"]
    paths = spark.createDataFrame([("a/b/c.java",), ("z.java",)], "path string")
    src = spark.createDataFrame([("a", 1), ("a/b", 2)], "source string, value int")
    assert {r["path"]: (r["source"], r["value"]) for r in builds.by_prefix(paths, src).collect()} == {"a/b/c.java": ("a/b", 2), "z.java": (None, None)}
    twins = spark.createDataFrame([("long/pom.xml", "i"), ("pom.xml", "i"), ("o/pom.xml", "j")], "pom string, ident string")
    assert {r["pom"] for r in builds.without_doubles(twins).collect()} == {"pom.xml", "o/pom.xml"}
    (tmp_path / "r.csv").write_text('"Problem","Package","File","Priority","Line","Description","Rule set","Rule"\n"1","","/w/A.java","3","7","d, e","s","UnusedImports"\n')
    assert [tuple(r) for r in files.pmd(spark, str(tmp_path / "r.csv"), "/w/").collect()] == [("A.java", 7, "UnusedImports")]
    (tmp_path / "p.json").write_text('[{"path": "a.py", "line": 3, "message-id": "C0111"}]')
    assert [tuple(r) for r in files.pylint(spark, str(tmp_path / "p.json")).collect()] == [("a.py", 3, "C0111")]
    (tmp_path / "d.json").write_text('{"collections": [{"model": "File", "documents": [{"id": "1", "path": "A"}]}, {"model": "X", "documents": []}]}')
    assert [tuple(r) for r in files.documents(spark, str(tmp_path / "d.json"), "File", "id:string,path:string").collect()] == [("1", "A")]


def test_store(spark, tmp_path):
    at = str(tmp_path)
    store.create(spark, at)
    f = spark.createDataFrame([("p", "r1", "A", '{"n": 1}'), ("p", "r1", "B", '{"n": 2}'), ("p", "r2", "A", '{"n": 1}')], "project string, rev string, path string, content string")
    store.save(f, at)
    store.save(f, at)
    assert spark.read.parquet(f"{at}/blobs").count() == 2 and spark.read.parquet(f"{at}/links").count() == 3
    assert {(r["path"], r["record"]["n"]) for r in store.load(spark, at, "p", "r2", "n int").collect()} == {("A", 1)}
    assert store.load(spark, at, "p", "none", "n int").count() == 0


def test_incremental(spark, tmp_path):
    src, at, cp = (str(tmp_path / x) for x in ("src", "at", "cp"))
    d = spark.range(10).withColumnRenamed("id", "rev")
    d.where("rev < 6").write.parquet(f"{src}")
    incremental.ingest(spark, src, d.schema, at, cp, "rev")
    d.where("rev > 3").write.mode("append").parquet(f"{src}")
    incremental.ingest(spark, src, d.schema, at, cp, "rev")
    assert sorted(r["rev"] for r in spark.read.parquet(at).collect()) == list(range(10))


def test_imports_without_the_llm_folders():
    code = "import sys\nclass No:\n    def find_spec(self, name, path=None, target=None):\n        if name == 'corpus_pipeline' or name.startswith('revlens.llm'):\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'w1_comm' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_branch_paths_begin_at_covered_commits():
    parents = {"c": ["b"], "b": ["a"]}
    assert graph.attached(["d", "c"], {"c"}, parents) == ["d", "c"] and graph.attached(["d", "c"], {"b"}, parents) == ["d", "c", "b"]
    with pytest.raises(ValueError):
        graph.attached(["d", "c"], {"a"}, parents)


def test_decayed_sums_are_those_of_their_definition():
    """term by term from the newest value on, to the bit; a convolution adds in another order."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=500)
    x[rng.random(500) < 0.1] = np.nan
    edge = np.array([0, 1, 200, 200, 500])
    got, want = linter.decayed_sums()(x, edge), []
    for i, j in zip(edge, edge[1:]):
        for at in range(i, j):
            total = 0.0
            for k, v in enumerate(v for v in x[i : at + 1][::-1] if v == v):
                total += v / (k + 1)
            want.append(total)
    assert got.tolist() == want


def test_rounded_as_products_are(spark):
    """3.4852724999999998 is a little below the tie, but its product with a million is at it: SQL rounds up, and Spark's round() follows the digits."""
    x = [3.4852724999999998, -3.4852724999999998, -2e-7, 2.675, None, float("inf"), *(np.random.default_rng(1).integers(0, 10**9, 2000) * 1e-7).tolist()]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", C.rounded(F.col("x"), 6).alias("y")).collect()
    for r in rows:
        assert str(r["y"]) == str(duckdb.execute("select round(?::double, 6)", [r["x"]]).fetchone()[0]), r["x"]


def test_decayed_sums_of_long_and_short_rows(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = [("f", i, float(v)) if i % 7 else ("f", i, None) for i, v in enumerate(rng.normal(size=3000))] + [("g", i, float(i)) for i in range(3)]
    got = {(r["k"], r["i"]): r["decayed_x"] for r in linter.decayed(spark.createDataFrame(x, "k string, i long, x double"), "k", ["i"], ["x"]).collect()}
    for k in "fg":
        seen = []
        for key, i, v in sorted(r for r in x if r[0] == k):
            seen += [v] if v is not None else []
            assert got[key, i] == pytest.approx(sum(s / (n + 1) for n, s in enumerate(reversed(seen))), abs=1e-9)


def test_rows_bring_their_columns_through_decayed_sums(spark):
    """rows are not joined with their own sums, and a window over the same key needs no other shuffle; all columns come through, rows without a key don't."""
    rows = spark.createDataFrame([("a", 1, 2.0, ["x"]), ("a", 2, None, []), ("b", 1, 4.0, None), (None, 1, 1.0, None)], "k string, i long, x double, l array<string>")
    out = linter.decayed(rows.withColumn("s", F.sum("x").over(Window.partitionBy("k").orderBy("i"))), "k", ["i"], ["x"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, 2.0, ["x"], 2.0, 2.0), ("a", 2, None, [], 2.0, 2.0), ("b", 1, 4.0, None, 4.0, 4.0)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_prefixes_by_order(spark):
    src = spark.createDataFrame([("a/b", "x", 2), ("a", "y", 3), ("c", "z", 1)], "source string, value string, ord int")
    got = {r["path"]: r["value"] for r in builds.by_prefix(spark.createDataFrame([("a/b/c.java",), ("c/d",), ("e",)], "path string"), src).collect()}
    assert got == {"a/b/c.java": "y", "c/d": "z", "e": None}


def test_rules_have_their_own_excludes(spark):
    xml = '<ruleset><rule ref="category/java/design.xml"><exclude name="A"/><exclude name="B"/></rule><rule ref="rulesets/X.xml/C"/><rule name="own"/><rule ref="category/java/other.xml">\n<exclude name="D"/></rule></ruleset>'
    got = [tuple(r) for r in files.rule_refs(spark.createDataFrame([("i", xml)], "ident string, xml string")).collect()]
    assert got == [("i", "category/java/design.xml", ["A", "B"]), ("i", "rulesets/X.xml/C", []), ("i", "category/java/other.xml", ["D"])]


def test_connectors():
    from revlens.sources import registry

    assert registry.connector("java") is files.pmd and registry.connector("pylint") is files.pylint
    with pytest.raises(ValueError):
        registry.connector("cobol")


def test_feature_names():
    """All names of the wide features, each once."""
    from revlens.operators import static

    names = static.feature_names([f"R{k}" for k in range(193)])
    assert len(names) == len(set(names)) == 4140 + 207 + 579
    assert {"parent_LOC_class_median", "current_WMC_enum_avg", "delta_TNPA_file", "delta_R7"} <= set(names)


def test_linter_runs(spark):
    runs = spark.createDataFrame([("a", 0), ("b", 4), ("c", 1)], "rev string, code int")
    sizes = spark.createDataFrame([(r, f, 5) for r in "abc" for f in ("x", "y")], "rev string, file string, lloc int")
    found = spark.createDataFrame([("b", "x", "R2"), ("b", "x", "R1"), ("c", "gone", "R1")], "rev string, file string, rule string")
    got = {(r["rev"], r["file"]): r["rules"] for r in linter.states(runs, sizes, found, "pmd").collect()}
    assert got == {("a", "x"): [], ("a", "y"): [], ("b", "x"): ["R1", "R2"], ("b", "y"): []}
    assert {r["rev"] for r in linter.good_runs(spark.createDataFrame([("a", 28), ("b", 32)], "rev string, code int"), "pylint").collect()} == {"a"}
    with pytest.raises(ValueError):
        linter.states(runs, sizes.where("file = 'y'"), found, "pmd")
    rules = spark.createDataFrame([("design", "A"), ("documentation", "CommentSize"), ("other", "B")], "category string, rule string")
    assert [r["rule"] for r in linter.checked_rules(rules).collect()] == ["A"]


def test_changed_lines_in_one_pass(spark):
    """Running counts of lines are one window, whatever the kinds; each line once, a verified one as deleted, too."""
    x = labels.hunk_lines(spark.createDataFrame([(1, " a\n-b\n+c\n-d\n d")], "id int, content string"), ["id"]).withColumn("o", F.lit(20)).withColumn("n", F.lit(10))
    out = labels.changed_lines(x, ["id"], "o", "n", spark.createDataFrame([(1, 3), (1, 3), (1, 2), (1, 9)], "id int, no int"))
    assert sorted((r["line"], r["kind"]) for r in out.collect()) == [(11, "added"), (21, "deleted"), (22, "deleted"), (22, "verified")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_hunks_are_shuffled_before_they_are_cut(spark):
    """the only shuffle of hunk_lines() is of hunks, not of their lines; a hunk of many lines and verified ones beyond the first hundreds are whole."""
    many = "\n".join("+-x"[k % 3] + str(k) for k in range(2000))
    rows = spark.createDataFrame([(1, many), (2, ""), (3, None), (4, "-")], "id int, content string")
    want = [(1, k, "+- "[k % 3], sum(1 for i in range(k) if i % 3 != 0), sum(1 for i in range(k) if i % 3 != 1)) for k in range(2000)] + [(2, 0, " ", 0, 0), (4, 0, "-", 0, 0)]
    for x in (labels.hunk_lines(rows, ["id"]), labels.hunk_lines(rows, ["id"]).drop("text")):
        plan = x._jdf.queryExecution().sparkPlan().toString() + x._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") in (1, 2) and plan.rindex("Exchange hashpartitioning") > plan.rindex("Generate")
    assert sorted(tuple(r) for r in labels.hunk_lines(rows, ["id"], text=False).collect()) == want
    x = labels.hunk_lines(rows, ["id"], text=False).withColumn("o", F.lit(0)).withColumn("n", F.lit(0))
    out = labels.changed_lines(x, ["id"], "o", "n", spark.range(2000).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("no")).where("no % 4 = 1"))
    assert out.where("kind = 'verified'").count() == sum(1 for k in range(2000) if k % 3 == 1 and k % 4 == 1) and out.where("kind = 'added'").count() == 667


def test_reachable_works_out_its_arcs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    arcs = spark.createDataFrame([(k, k + 1) for k in range(6)] + [(9, 10)], "parent int, child int").mapInArrow(passed, "parent int, child int")
    out = graph.reachable(spark.createDataFrame([(2,)], "node int"), arcs)
    assert sorted(r["node"] for r in out.collect()) == [2, 3, 4, 5, 6]
    assert seen.value == 7


def test_rewritten_parents_without_a_shuffle_of_files(spark):
    """Many files of one parent don't meet in one task, however large Spark takes the rules to be."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        p = spark.createDataFrame([("a", "g", "x", "1", None)] * 3, "pom string, group string, artifact string, version string, relative string")
        out = builds.rewritten_parents(p, spark.createDataFrame([("g", "x", "1", "2")], "group string, artifact string, version string, new_version string"))
        assert "BroadcastHashJoin" in out._jdf.queryExecution().toString() and [r["version"] for r in out.collect()] == ["2"] * 3
    finally:
        spark.conf.set(key, before)
