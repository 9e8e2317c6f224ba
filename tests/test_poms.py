import pytest
from pyspark.sql import functions as F

from revlens.operators import poms
from revlens.sources.files import rule_refs

K = ["rev"]
NS = 'xmlns="http://maven.apache.org/POM/4.0.0" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://maven.apache.org/POM/4.0.0 x"'


def pom(artifact, body="", parent=None, group="local.test", version="1.0", xml=""):
    up = f"<parent><artifactId>{parent[0]}</artifactId><groupId>local.test</groupId><version>{parent[1]}</version></parent>" if parent else ""
    own = (f"<groupId>{group}</groupId>" if group else "") + f"<artifactId>{artifact}</artifactId>" + (f"<version>{version}</version>" if version else "")
    return f"{xml}<project {NS}>\n<modelVersion>4.0.0</modelVersion>{up}{own}{body}\n</project>"


def modules(*names):
    return "<modules>" + "".join(f"<module>{n}</module>" for n in names) + "</modules>"


def pmd(version="3.8", settings="", more=""):
    return f"<plugin><artifactId>maven-pmd-plugin</artifactId><version>{version}</version>{more}<configuration><targetJdk>1.8</targetJdk>{settings}</configuration></plugin>"


def plugins(*of):
    return f"<plugins>{''.join(of)}</plugins>"


RULES = "<rulesets><ruleset>${basedir}/pmd-ruleset.xml</ruleset></rulesets>"
#: A top file with two modules; only one has the plugin, in both of its sections.
TREE = {
    "pom.xml": pom("top", modules("package3", "package1"), xml='<?xml version="1.0" encoding="UTF-8"?>\n'),
    "package1/pom.xml": pom("package1", parent=("top", "1.0"), version="1.0-SNAPSHOT"),
    "package3/pom.xml": pom("package3", "<properties><pmd.version>3.8</pmd.version></properties><build>" + plugins(pmd("${pmd.version}", RULES)) + "</build><reporting>" + plugins(pmd("${pmd.version}", RULES)) + "</reporting>", ("top", "1.0"), version="1.0-SNAPSHOT"),
}


def files(spark, tree, rev="r"):
    return spark.createDataFrame([(rev, p, x) for p, x in tree.items()], "rev string, path string, xml string")


def roots(spark, tree, **kw):
    read = poms.parsed(poms.with_stand_in(files(spark, tree), K))
    return {r["path"] for r in poms.main_files(read, K, **kw).collect()}


def effective(spark, tree, **kw):
    out = poms.effective(files(spark, tree), K, **kw)
    got = {r["path"]: r["error"] for r in out.collect()}
    rows = {r["ident"]: r for r in poms.records(out.drop("error"), kw.get("base", "")).collect()}
    return got, rows


def test_roots(spark):
    assert roots(spark, TREE) == {"pom.xml"}
    assert roots(spark, {"pom.xml": pom("a")}) == {"pom.xml"} == roots(spark, {"project.xml": pom("a"), "x.xml": "<a/>"})
    # the parent stands in a folder of its name, beside those that name it
    assert roots(spark, {"main/pom.xml": pom("main", modules("../p1")), "p1/pom.xml": pom("p1", parent=("main", "1.0")), "p2/pom.xml": pom("p2", parent=("main", "1.0"))}) == {"main/pom.xml"}
    assert roots(spark, {"a/b/pom.xml": pom("b", parent=("x", "1"))}) == set()
    assert roots(spark, {"a/pom.xml": pom("a"), "giraph/pom.xml": pom("g")}, ignored="giraph/pom.xml$") == {"a/pom.xml"}


def test_modules(spark):
    edges, missing = poms.tree(poms.parsed(files(spark, TREE | {"pom.xml": pom("top", modules("package3", "package1", "gone", "a.b")), "a/b/pom.xml": pom("b")})), K)
    assert {(r["parent"], r["child"]) for r in edges.collect()} == {("pom.xml", "package3/pom.xml"), ("pom.xml", "package1/pom.xml"), ("pom.xml", "a/b/pom.xml")}
    assert [(r["parent"], r["child"]) for r in missing.collect()] == [("pom.xml", "gone/pom.xml")]


@pytest.mark.parametrize("bad", ["<project><modules><module>a</module></modulesA></project>", "", None, "no xml"])
def test_malformed(spark, bad):
    row = poms.parsed(spark.createDataFrame([("r", "pom.xml", bad)], "rev string, path string, xml string")).first()
    assert row["malformed"] and row["projects"] is None
    assert effective(spark, {"pom.xml": bad})[0] == {"pom.xml": "malformed"}


def test_several_projects_and_the_tool_s_own_lines(spark):
    inner = "".join(x[x.index("<project ") :] + "\n" for x in (TREE["pom.xml"], TREE["package3/pom.xml"]))
    text = f'[INFO] scanning\n<?xml version="1.0"?>\n<projects>\n{inner}</projects>\n[INFO] done </project>\n'
    single = f"[INFO] x\n  <?xml version='1.0'?>\n{TREE['package1/pom.xml']}\n[INFO] done\n"
    out = spark.createDataFrame([("a", text), ("b", single)], "rev string, output string").select("rev", poms.document(F.col("output")).alias("xml"))
    rows = {(r["rev"], r["ident"]): r for r in poms.records(poms.parsed(out)).collect()}
    assert set(rows) == {("a", "local.test:top-1.0"), ("a", "local.test:package3-1.0-SNAPSHOT"), ("b", "local.test:package1-1.0-SNAPSHOT")}
    # whether a tool is in use is asked of the whole document
    assert rows["a", "local.test:top-1.0"]["use_pmd"] and not rows["b", "local.test:package1-1.0-SNAPSHOT"]["use_pmd"]


def test_all_fields(spark):
    settings = """<minimumPriority>3</minimumPriority><language>JSP</language><compileSourceRoots><compileSourceRoot>src/own</compileSourceRoot></compileSourceRoots>
<testSourceRoots><testSourceRoot>src/t</testSourceRoot></testSourceRoots><includeTests>True</includeTests><excludeFromFailureFile>f.properties</excludeFromFailureFile>
<rulesets><ruleset>b.xml</ruleset><ruleset>/rulesets/basic.xml</ruleset></rulesets><excludeRoots><excludeRoot>/w/gen</excludeRoot></excludeRoots>
<excludes><exclude>**/A.java, **/B.java,</exclude><exclude>**/A.java</exclude></excludes><includes><include>**/C.java</include></includes>"""
    body = f"""<build><sourceDirectory>/w/src/own</sourceDirectory><pluginManagement>{plugins(pmd('9', '<minimumPriority>4</minimumPriority>'))}</pluginManagement>{plugins(pmd('3', settings), '<plugin><artifactId>spotbugs-maven-plugin</artifactId></plugin>')}</build>
<reporting>{plugins(pmd('2', '<rulesets><ruleset>a.xml</ruleset></rulesets>'), '<plugin><artifactId>findbugs-maven-plugin</artifactId></plugin>', '<plugin><groupId>org.codehaus.sonar-plugins</groupId><artifactId>x</artifactId></plugin>')}</reporting>
<dependencies><dependency><groupId>com.google.errorprone</groupId><artifactId>e</artifactId></dependency></dependencies>"""
    r = poms.records(poms.parsed(files(spark, {"pom.xml": pom("a", body, group=None)})), "/w").first().asDict()
    assert r["ident"] == "unknown:a-1.0"
    want = {"use_pmd": True, "use_checkstyle": False, "use_findbugs": True, "use_spotbugs": True, "use_sonarcube": True, "use_errorprone": True, "custom_rule_files": ["/rulesets/basic.xml", "a.xml", "b.xml"], "exclude_roots": ["gen"],
            "excludes": ["**/A.java", "**/B.java"], "includes": ["**/C.java"], "include_tests": True, "exclude_from_failure": ["f.properties"], "language": "jsp", "minimum_priority": "4", "source_directory": "src/own",
            "test_source_directory": "src/t", "plugin_build": 1, "plugin_reporting": 1, "version": "9", "conflict": False}
    assert {k: r[k] for k in want} == want
    plain = poms.records(poms.parsed(files(spark, {"pom.xml": pom("b")}))).first()
    assert (plain["language"], plain["minimum_priority"], plain["source_directory"], plain["use_errorprone"], plain["plugin_build"], plain["custom_rule_files"]) == ("java", "5", None, False, 0, [])


def test_effective(spark):
    errors, rows = effective(spark, TREE, base="/w")
    assert set(errors.values()) == {None}
    assert set(rows) == {"local.test:top-1.0", "local.test:package3-1.0-SNAPSHOT", "local.test:package1-1.0-SNAPSHOT"}
    main, own, other = rows["local.test:top-1.0"], rows["local.test:package3-1.0-SNAPSHOT"], rows["local.test:package1-1.0-SNAPSHOT"]
    assert own["use_pmd"] and own["version"] == "3.8" and own["custom_rule_files"] == ["/w/package3/pmd-ruleset.xml"] and (own["plugin_build"], own["plugin_reporting"]) == (1, 1)
    assert not main["use_pmd"] and not other["use_pmd"]
    assert (main["source_directory"], main["test_source_directory"], other["source_directory"]) == ("src/main/java", "src/test/java", "package1/src/main/java")


def test_inheritance(spark):
    """Group, version, properties and plugins come down three levels; the nearest counts; properties refer to properties; some plugins stay; managed settings fill in."""
    top = pom("top", "<properties><a>${b}-x</a><b>${c}</b><c>1</c><q>say \"\\\"</q></properties><build><sourceDirectory>${project.artifactId}/src</sourceDirectory>"
              + "<pluginManagement>" + plugins(pmd("7", "<minimumPriority>2</minimumPriority><language>${q}</language>")) + "</pluginManagement>"
              + plugins(pmd("${a}", "<excludes><exclude>${project.version}.java</exclude></excludes>"), pmd("1").replace("maven-pmd", "maven-checkstyle").replace("</version>", "</version><inherited>false</inherited>")) + "</build>", version="5")
    mid = pom("mid", "<properties><c>2</c></properties>", ("top", "5"), group=None, version=None)
    low = pom("low", "<build>" + plugins(pmd("8", "<includes><include>${unknown}</include></includes>").replace("<version>8</version>", "")) + "</build>", ("mid", "5"), version="6")
    errors, rows = effective(spark, {"pom.xml": top, "m/pom.xml": mid, "m/l/pom.xml": low})
    assert set(errors.values()) == {None} and set(rows) == {"local.test:top-5", "local.test:mid-5", "local.test:low-6"}
    r = rows["local.test:low-6"]
    own = poms.effective(files(spark, {"pom.xml": top, "m/pom.xml": mid, "m/l/pom.xml": low}), K).where("path = 'm/l/pom.xml'").first()["projects"][0]
    assert [(x["artifactId"], x["version"]) for x in own["build"]["plugins"]["plugin"]] == [("maven-pmd-plugin", "2-x")]
    # a record's order of sections puts managed settings last
    assert r["version"] == "7" and r["minimum_priority"] == "2" and r["excludes"] == ["6.java"] and r["includes"] == ["${unknown}"] and r["language"] == 'say "\\"'
    assert r["source_directory"] == "m/l/low/src" and not r["use_checkstyle"] and rows["local.test:top-5"]["use_checkstyle"] and rows["local.test:top-5"]["version"] == "7"
    assert rows["local.test:mid-5"]["source_directory"] == "m/mid/src"


def test_errors(spark):
    errors, _ = effective(spark, {"pom.xml": pom("a", modules("none")), "b/pom.xml": pom("b", parent=("gone", "1")), "c/pom.xml": pom("c", parent=("b", "1.0")), "d/pom.xml": pom("d")})
    assert errors == {"pom.xml": "child", "b/pom.xml": "parent", "c/pom.xml": "parent", "d/pom.xml": None}
    loop = {"a/pom.xml": pom("a", parent=("b", "1.0")), "b/pom.xml": pom("b", parent=("a", "1.0"))}
    assert set(effective(spark, loop)[0]) == {"a/pom.xml", "b/pom.xml"}


def test_replaced_parents(spark):
    rules = spark.createDataFrame([("local.test", "top", "0.1", "1.0")], "group string, artifact string, version string, new_version string")
    tree = {"pom.xml": pom("top"), "b/pom.xml": pom("b", parent=("top", "0.1")), "c/pom.xml": pom("c", parent=("top", "1.0-SNAPSHOT")), "d/pom.xml": pom("d", parent=("top", "0.3"))}
    assert effective(spark, tree, rewrites=rules)[0] == {"pom.xml": None, "b/pom.xml": None, "c/pom.xml": None, "d/pom.xml": "parent"}
    assert effective(spark, tree)[0]["b/pom.xml"] == "parent"


def test_rules(spark):
    """A set is expanded, an exclude leaves out one rule of it, a file that isn't there stands for the set of its name, one of no name adds nothing."""
    ruleset = '<ruleset xmlns="http://pmd.sourceforge.net/ruleset/2.0.0"><rule ref="rulesets/java/basic.xml"/><rule ref="rulesets/java/imports.xml"><exclude name="DuplicateImport"/></rule><rule ref="rulesets/java/x.xml/Single"/><rule name="own"/></ruleset>'
    sets = spark.createDataFrame([("basic", ["CheckResultSet", "JumbledIncrementer"]), ("imports", ["DontImportJavaLang", "DuplicateImport"])], "ruleset string, rules array<string>")
    refs = rule_refs(spark.createDataFrame([("/w/pmd.xml", ruleset)], "ident string, xml string")).select(F.lit("r").alias("rev"), F.col("ident").alias("file"), "ref", "excluded")
    use = lambda *names: "<build>" + plugins(pmd("1", "<rulesets>" + "".join(f"<ruleset>{n}</ruleset>" for n in names) + "</rulesets>")) + "</build>"
    tree = {"a/pom.xml": pom("a", use("/w/pmd.xml")), "b/pom.xml": pom("b", use("/rulesets/Basic.xml", "/w/none.xml")), "c/pom.xml": pom("c", "<build>" + plugins(pmd("1")) + "</build>"), "d/pom.xml": pom("d")}
    rec = poms.records(poms.parsed(files(spark, tree)))
    got = {r["ident"].split(":")[1][0]: (r["rules"], r["custom_rule_files"]) for r in poms.with_rules(rec, refs, sets, ["Z", "A"], K).collect()}
    assert got == {"a": (["CheckResultSet", "DontImportJavaLang", "JumbledIncrementer", "Single"], ["/w/pmd.xml"]), "b": (["CheckResultSet", "JumbledIncrementer"], ["/w/none.xml"]), "c": (["A", "Z"], []), "d": ([], [])}


def test_doubles(spark):
    rows = spark.createDataFrame([("r", "a/pom.xml", "x"), ("r", "longer/pom.xml", "x"), ("r", "c/pom.xml", "y"), ("s", "longer/pom.xml", "x")], "rev string, path string, ident string")
    assert {(r["rev"], r["path"]) for r in poms.without_doubles(rows, K).collect()} == {("r", "a/pom.xml"), ("r", "c/pom.xml"), ("s", "longer/pom.xml")}


def test_build_files_go_to_all_cores(spark):
    """A few bytes of build files are much work: they aren't left in the one task that their bytes would fill."""
    x = spark.createDataFrame([("r", f"a{k}/pom.xml", f"<project><groupId>g</groupId><artifactId>a{k}</artifactId><version>1</version></project>") for k in range(64)], "rev string, path string, xml string").coalesce(1)
    tasks = poms.parsed(x).select(F.spark_partition_id().alias("p"), "projects").where("projects is not null").select("p").distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism
