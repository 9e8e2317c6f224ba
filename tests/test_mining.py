import os
import subprocess

import pytest

from revlens.plans.mining import mine


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("features")

    def run(*args, when, who="test"):
        env = os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": who, "GIT_COMMITTER_NAME": who, "GIT_AUTHOR_EMAIL": f"{who}@test.local", "GIT_COMMITTER_EMAIL": f"{who}@test.local"}
        subprocess.run(["git", "-C", str(at), *args], check=True, capture_output=True, env=env)

    def put(path, text):
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_text(text)

    day = "2018-01-{:02d}T01:00:00+0200".format
    run("init", "-q", "-b", "master", when=day(1))
    put("p1/Main.java", "a\nb\nc\nd\ne\n")
    put("p2/Main.java", "a\nb\nc\nd\ne\n")
    put("notes.txt", "x\n")
    run("add", ".", when=day(1))
    run("commit", "-qm", "a", when=day(1))
    put("p1/Main.java", "a\nb\nBAD\nd\ne\n")
    run("commit", "-qam", "b", when=day(3), who="test2")
    run("mv", "p1/Main.java", "p1/Other.java", when=day(4))
    run("commit", "-qam", "c", when=day(4))
    put("p1/Other.java", "a\nb\ngood\nd\ne\n")
    run("commit", "-qam", "Fix d", when=day(9))
    return str(at)


def test_rows(spark, repo):
    rows = sorted(mine(spark, repo).collect(), key=lambda r: (r["seq"], r["mod_idx"]))
    assert [(r["file"], r["change_type"]) for r in rows] == [("p1/Main.java", "ADD"), ("p2/Main.java", "ADD"), ("p1/Main.java", "MODIFY"), ("p1/Other.java", "RENAME"), ("p1/Other.java", "MODIFY")]
    assert {r["oldest_name"] for r in rows[2:]} == {"p1/Main.java"}
    assert [r["comm"] for r in rows] == [1, 1, 2, 3, 4] and [r["age"] for r in rows] == [0, 0, 2, 1, 5]
    assert [r["kamei_nf"] for r in rows] == [3, 3, 1, 1, 1] and [r["nuc"] for r in rows] == [0, 0, 1, 2, 3]
    assert rows[0]["add"] == pytest.approx(5 / 11) and rows[4]["fix_bug"] and not rows[3]["fix_bug"]
    assert [r["kamei_exp"] for r in rows] == [1, 1, 1, 2, 3] and {r["pathnum"] for r in rows} == {0}
    bug = f"adhoc__{rows[4]['commit']}__2018-01-09 01:00:00+02:00"
    assert [r[bug] for r in rows] == [0, 0, 1, 0, 0] and [r["previous_inducing"] for r in rows] == [0, 0, 0, 1, 1]
    assert [r["pascarella_commit"] for r in rows] == [False, False, True, False, False] == [r["pascarella_file"] for r in rows]
    assert [r["kamei_lt"] for r in rows] == [-1, -1, 5, 5, 5] and [r["lt"] for r in rows] == [5] * 5 and [r["kamei_sexp"] for r in rows] == [2, 2, 1, 2, 3]
    # commits of the author in each year over its distance, times the tracked files
    assert [r["kamei_rexp"] for r in rows] == [2, 2, 1, 2, 3] and not any(r["quality_asat_commit"] for r in rows)


def test_lines(spark, repo):
    from revlens.sources import git

    git.register(spark)
    rows = spark.read.format("revlens_git").options(path=repo, table="lines").load().collect()
    last = max((r["rev"] for r in rows), key=lambda v: sum(x["rev"] == v for x in rows))
    first = [r for r in rows if r["rev"] == last]  # everything is added in the first commit
    assert {(r["path"], r["kind"]) for r in first} == {("p1/Main.java", "added"), ("p2/Main.java", "added"), ("notes.txt", "added")} and len(first) == 11
    assert sorted((r["path"], r["kind"], r["line"], r["text"]) for r in rows if r["rev"] != last) == [
        ("p1/Main.java", "added", 3, "BAD"), ("p1/Main.java", "deleted", 3, "c"), ("p1/Other.java", "added", 3, "good"), ("p1/Other.java", "deleted", 3, "BAD"),
    ]


HALLO = ["public class Main {", "\tpublic static void main(String[] args) {", '\t\tSystem.out.println("Hallo");', "\t}", "}"]
BLANK = [*HALLO[:2], "", *HALLO[3:]]
LESS = [*HALLO[:2], *HALLO[3:]]


def history(at):
    """Functions that put lines into a file and run git at a time."""
    def run(*args, when="2018-01-01 03:01:01 +0200"):
        who = {f"GIT_{a}_{b}": v for a in ("AUTHOR", "COMMITTER") for b, v in (("NAME", "Test User"), ("EMAIL", "test@test.local"), ("DATE", when))}
        subprocess.run(["git", "-C", str(at), *args], check=True, capture_output=True, env=os.environ | who)

    def put(name, lines, msg, when):
        (at / name).write_text("\n".join(lines) + "\n")
        run("add", "-A", when=when)
        run("commit", "-qm", msg, when=when)

    run("init", "-q", "-b", "master")
    return run, put


def mined(spark, at, **kw):
    return sorted(mine(spark, str(at), keywords=["fix"], **kw).collect(), key=lambda r: (r["seq"], r["mod_idx"]))


def test_rename_on_a_branch(spark, tmp_path):
    """The fix of a renamed file on a branch leads back to the old name; the branch is a path of its own, and its merge has no rows of its own."""
    run, put = history(tmp_path)
    put("Main.java", BLANK, "(a) init, added Main.java", "2018-01-01 03:01:01 +0200")
    run("checkout", "-qb", "branch1")
    put("Main.java", HALLO, "(b) add output", "2018-01-03 03:01:01 +0200")
    run("mv", "Main.java", "Rubbish.java")
    run("commit", "-qam", "(c) move file", when="2018-01-04 03:01:01 +0200")
    put("Rubbish.java", LESS, "(d) fix, remove unneeded output", "2018-01-05 03:01:01 +0200")
    run("checkout", "-q", "master")
    put("Main2.java", [x.replace("Main", "Main2") for x in HALLO], "(b2) add output in branch master for Main2.java", "2018-01-03 03:01:01 +0200")
    run("merge", "-q", "-m", "merge", "branch1", when="2018-01-06 03:01:01 +0200")
    rows = mined(spark, tmp_path)
    by = {(r["file"], r["change_type"]): r for r in rows if len([x for x in rows if x["commit"] == r["commit"]]) == 1}
    fix = by["Rubbish.java", "MODIFY"]
    bug = f"adhoc__{fix['commit']}__2018-01-05 03:01:01+02:00"
    bad = by["Main.java", "MODIFY"]
    assert (bad[bug], fix[bug]) == (1, 0) and fix["fix_bug"] and fix["oldest_name"] == "Main.java" and fix["comm"] == 4
    assert bad["pathnum"] != by["Main2.java", "ADD"]["pathnum"] and bad["pascarella_file"] and not fix["pascarella_file"]
    # the merge counts as what it changes against its first parent: the file's new name
    assert [(r["file"], r["change_type"]) for r in rows if r["seq"] == 5] == [("Rubbish.java", "RENAME")]


def test_dates_out_of_order(spark, tmp_path):
    _, put = history(tmp_path)
    put("Main.java", BLANK, "(a)", "2018-01-01 03:01:01 +0200")
    put("Main.java", HALLO, "(b)", "2018-01-03 03:01:01 +0200")
    put("Main.java", LESS, "(c) fix", "2018-01-02 03:01:01 +0200")
    assert [r["committer_local"].day for r in mined(spark, tmp_path)] == [1, 3, 2]


def test_odd_names_and_a_limit(spark, tmp_path):
    """A fix in a file whose name Git quotes is blamed; fixes of fifty files or after the last day flag nothing, but label."""
    _, put = history(tmp_path)
    name = 'é "a\tb.java'
    put(name, HALLO, "(a)", "2018-01-01 03:01:01 +0200")
    put(name, [*HALLO[:2], "bad", *HALLO[3:]], "(b)", "2018-01-02 03:01:01 +0200")
    for k in range(49):
        (tmp_path / f"n{k}.txt").write_text("x\n")
    put(name, LESS, "(c) fix", "2018-01-03 03:01:01 +0200")
    rows = mined(spark, tmp_path)
    bug = f"adhoc__{rows[2]['commit']}__2018-01-03 03:01:01+02:00"
    assert [r["file"] for r in rows] == [name] * 3 and [r[bug] for r in rows] == [0, 1, 0] and not any(r["pascarella_file"] for r in rows)
    put(name, HALLO, "(d)", "2018-01-04 03:01:01 +0200")
    put(name, LESS, "(e) fix", "2018-01-05 03:01:01 +0200")
    assert [r["pascarella_file"] for r in mined(spark, tmp_path)] == [False, False, False, True, False]
    assert not any(r["pascarella_file"] for r in mined(spark, tmp_path, until="2018-01-04 23:59:59"))


def test_code_length():
    from revlens.sources.git import code_length

    assert code_length("A.java", 'a /* x\n y */\n\n// z\n"/* no */" // q\n c') == 3
    assert code_length("a.py", "# x\n\ny = 1  # z\ns = '#'\n") == 2 and code_length("a.txt", "x") is None


def lines_of_commit(touches, tables):
    """A column of its own: the lines that the commit adds."""
    added = tables["lines"].where("kind = 'added'").groupBy("rev").count().withColumnRenamed("count", "own_lines")
    return touches.join(added, "rev", "left")


def test_complete_row(spark, tmp_path):
    """Warnings on changed lines, static metrics against the parent, the build's settings as they stand, validated fixes and named labels."""
    from revlens.plans.complete import Extra

    run, put = history(tmp_path)
    pom = '<project xmlns="http://maven.apache.org/POM/4.0.0"><groupId>g</groupId><artifactId>a</artifactId><version>1</version>{}</project>'
    plugin = "<build><plugins><plugin><artifactId>maven-pmd-plugin</artifactId></plugin></plugins></build>"
    (tmp_path / "src/main/java").mkdir(parents=True)
    name = "src/main/java/Main.java"
    put(name, BLANK, "(a)", "2018-01-01 03:01:01 +0200")
    put("pom.xml", [pom.format("")], "(b)", "2018-01-02 03:01:01 +0200")
    put(name, HALLO, "(c)", "2018-01-03 03:01:01 +0200")
    put("pom.xml", [pom.format(plugin)], "(d)", "2018-01-04 03:01:01 +0200")
    (tmp_path / "Other.java").write_text("x\n")
    put(name, LESS, "(e) fix", "2018-01-05 03:01:01 +0200")
    put("pom.xml", ["<project><broken>"], "(f)", "2018-01-06 03:01:01 +0200")
    put(name, HALLO, "(g)", "2018-01-07 03:01:01 +0200")
    log = subprocess.run(["git", "-C", str(tmp_path), "log", "--reverse", "--format=%H"], capture_output=True, check=True).stdout.decode().split()
    a, b, c, d, e, f, g = log
    warnings = [(r, name, 1, "Old") for r in log] + [(c, name, 3, "Print"), (d, name, 3, "Print"), (g, name, 3, "Print")]
    sizes = [(r, name, 4) for r in log] + [(r, "Other.java", 6) for r in (e, f, g)]
    extra = Extra(
        warnings=spark.createDataFrame(warnings, "rev string, file string, line int, rule string"), sizes=spark.createDataFrame(sizes, "rev string, file string, lloc long"), default_rules=("Print",),
        metrics=spark.createDataFrame([(r, name, "McCC", float(k)) for k, r in enumerate(log)] + [(c, name, "WMC", 5.0)], "rev string, file string, name string, value double"),
        bugfixes=spark.createDataFrame([(e, name)], "rev string, file string"), named=spark.createDataFrame([("SZZ", c, name, "BUG-1")], "label string, rev string, file string, bug_id string"), builds=True, plugins=(lines_of_commit,),
    )
    rows = {(r["commit"], r["file"]): r for r in mined(spark, tmp_path, extra=extra)}
    assert set(rows) == {(a, name), (c, name), (e, name), (e, "Other.java"), (g, name)}
    main = [rows[x, name] for x in (a, c, e, g)]
    assert [r["linter_warnings"] for r in main] == [1, 2, 1, 2] and rows[e, "Other.java"]["linter_warnings"] == 0 and rows[e, name]["linter_lloc"] == 10
    assert [r["linter_warning_list"] for r in main] == [["Old"], ["Old", "Print"], ["Old"], ["Old", "Print"]]
    assert [r["linter_added_warnings"] for r in main] == [["Old"], ["Print"], [], ["Print"]] and [r["linter_deleted_warnings"] for r in main] == [[], [], ["Print"], []]
    assert [r["current_WD"] for r in main] == [0.25, 0.5, 0.25, 0.5] and [r["current_default_WD"] for r in main] == [0, 0.25, 0, 0.25]
    assert rows[c, name]["delta_system_WD"] == pytest.approx(0.25) and rows[e, name]["system_WD"] == pytest.approx(0.1) and rows[e, name]["parent_WD"] == 0.5
    assert rows[c, name]["file_system_sum_WD"] == 0 and rows[e, name]["file_system_sum_WD"] == pytest.approx(0.15)
    assert [r["current_McCC"] for r in main] == [0, 2, 4, 6] and [r["delta_McCC"] for r in main] == [0, 1, 1, 1] and (rows[c, name]["current_WMC"], rows[e, name]["delta_WMC"]) == (5, 0)
    assert [r["use_maven"] for r in main] == [False, True, True, True] and [r["use_pmd"] for r in main] == [False, False, True, True] and not rows[e, "Other.java"]["use_pmd"] and rows[e, "Other.java"]["use_maven"]
    assert [r["validated_bugfix"] for r in main] == [False, False, True, False] and [r["SZZ__BUG-1"] for r in main] == [0, 1, 0, 0]
    assert [r["own_lines"] for r in main] == [5, 1, 1, 1]
    bug = f"adhoc__{e}__2018-01-05 03:01:01+02:00"
    assert [r[bug] for r in main] == [0, 1, 0, 0]
    lists = {(r["commit"], r["file"]): r["bug_ids"] for r in mined(spark, tmp_path, extra=extra, matrix=False)}
    assert lists[c, name] == sorted([bug, "SZZ__BUG-1"]) and lists[a, name] == []


def test_matrix_of_many_bugs(spark, tmp_path):
    from revlens.operators import store

    rows = spark.createDataFrame([(f"r{k}", "f", k) for k in range(5)], "rev string, file string, mod_idx int")
    marks = [(f"r{k % 4}", "f", f"bug{k:03d}") for k in range(50)]
    assert store.write_matrix(rows, spark.createDataFrame(marks, "rev string, file string, bug_id string"), str(tmp_path / "m"), ["rev", "file", "mod_idx"], size=20) == 3
    seen = {}
    for k in range(3):
        part = spark.read.csv(f"{tmp_path}/m/bugs-{k:05d}", header=True)
        assert part.count() == 5 and len(part.columns) == 3 + (20, 20, 10)[k]
        for r in part.collect():
            seen |= {(r["rev"], b): int(r[b]) for b in part.columns[3:]}
    assert {k for k, v in seen.items() if v} == {(r, b) for r, _, b in marks} and len(seen) == 250


def test_state_of_a_run(spark, tmp_path):
    """A second run on what the first one kept gives the rows of mining all at once, and reads new commits only; a batch without tips doesn't count."""
    run, put = history(tmp_path / "repo") if (tmp_path / "repo").mkdir() is None else None
    at = str(tmp_path / "state")
    put("Main.java", BLANK, "(a)", "2018-01-01 03:01:01 +0200")
    put("Main.java", HALLO, "(b)", "2018-01-02 03:01:01 +0200")
    path = tmp_path / "repo"
    assert mined(spark, path, state=at) == mined(spark, path)
    run("checkout", "-qb", "other", "HEAD~1")
    put("Two.java", HALLO, "(c)", "2018-01-03 03:01:01 +0200")
    run("checkout", "-q", "master")
    put("Main.java", LESS, "(d) fix", "2018-01-04 03:01:01 +0200")
    spark.read.parquet(f"{at}/lines/batch=0").limit(1).write.parquet(f"{at}/lines/batch=1")  # a run that was cut short
    both = mined(spark, path, state=at)
    assert both == mined(spark, path) and len(both) == 4
    count = lambda k: spark.read.parquet(f"{at}/modifications/batch={k}").select("rev").distinct().count()
    assert (count(0), count(1)) == (2, 2)
    assert mined(spark, path, state=at) == both and not (tmp_path / "state/tips/batch=2").exists()
