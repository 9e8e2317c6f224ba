"""Build files as a table: the tree that their modules and parents make, the records of their projects, and effective projects from the given files alone.

Everything is columns: from_xml() with a schema, arrays along the line of parents, and joins on identities. Keys, at least one, such as a revision, separate the files of one tree from those of others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.store import kept

CONFIGURATION = "struct<minimumPriority:string,language:string,compileSourceRoots:struct<compileSourceRoot:array<string>>,testSourceRoots:struct<testSourceRoot:array<string>>,includeTests:string,excludeFromFailureFile:array<string>,rulesets:struct<ruleset:array<string>>,excludeRoots:struct<excludeRoot:array<string>>,excludes:struct<exclude:array<string>>,includes:struct<include:array<string>>>"
PLUGINS = f"struct<plugin:array<struct<groupId:string,artifactId:string,version:string,inherited:string,configuration:{CONFIGURATION}>>>"
SECTION = f"plugins:{PLUGINS},pluginManagement:struct<plugins:{PLUGINS}>"
FIELDS = {
    "groupId": "string", "artifactId": "string", "version": "string", "parent": "struct<groupId:string,artifactId:string,version:string,relativePath:string>", "modules": "struct<module:array<string>>",
    "properties": "map<string,string>", "build": f"struct<sourceDirectory:string,testSourceDirectory:string,{SECTION}>", "reporting": f"struct<{SECTION}>",
}
PROJECT = "struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ">"
#: Where a project's sources are unless it says otherwise, and the names of plugins and groups that a record tells of.
SOURCES, TEST_SOURCES = "src/main/java", "src/test/java"
PMD, CHECKSTYLE, FINDBUGS, SPOTBUGS, SONAR, ERRORPRONE = "maven-pmd-plugin", "maven-checkstyle-plugin", "findbugs-maven-plugin", "spotbugs-maven-plugin", "org.codehaus.sonar-plugins", "com.google.errorprone"


def document(output: Column) -> Column:
    """The XML document in the output of a tool: from the line that begins it to the one that ends its project, or its projects."""
    whole = F.regexp_extract(output, r"(?ms)^\s*(<\?xml.*^\s*</projects>)", 1)
    one = F.regexp_extract(output, r"(?ms)^\s*(<\?xml.*?^\s*</project>)", 1)
    return F.when(output.rlike(r"(?m)^\s*<projects[ >]"), whole).otherwise(one)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores: a build file takes much work for few bytes, by which Spark would put thousands of them into one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def parsed(texts: DataFrame) -> DataFrame:
    """texts (keys..., xml) with projects (array of PROJECT, null if malformed) and malformed. A document holds one project, or several within <projects>; name spaces don't matter."""
    read = lambda schema: F.from_xml("xml", schema, {"ignoreNamespace": "true"})
    many = spread(texts).withColumn("several", F.coalesce(F.col("xml").rlike(r"<projects[\s>]"), F.lit(False)))
    both = many.withColumn("m", F.when(F.col("several"), read(f"struct<project:array<{PROJECT}>,_corrupt_record:string>"))).withColumn("o", F.when(~F.col("several"), read(PROJECT[:-1] + ",_corrupt_record:string>")))
    bad = F.col("xml").isNull() | (F.trim("xml") == "") | F.col("m._corrupt_record").isNotNull() | F.col("o._corrupt_record").isNotNull()
    one = F.array(F.struct(*(F.col(f"o.{f}").alias(f) for f in FIELDS)))
    return both.withColumn("malformed", bad).withColumn("projects", F.when(~bad, F.when(F.col("several"), F.col("m.project")).otherwise(one))).drop("m", "o", "several")


def or_unknown(*cs: Column) -> Column:
    return F.coalesce(*cs, F.lit("unknown"))


def ident(p: Column) -> Column:
    return F.concat(or_unknown(p["groupId"]), F.lit(":"), or_unknown(p["artifactId"]), F.lit("-"), or_unknown(p["version"]))


def folder(path: str | Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def with_stand_in(files: DataFrame, keys: list[str]) -> DataFrame:
    """files (keys..., path, xml) of the name pom.xml; a project.xml at the top stands in for one that isn't there."""
    own = files.where(F.col("path").rlike(r"(^|/)pom\.xml$"))
    top = own.where("path = 'pom.xml'").select(*keys)
    stand_in = files.where("path = 'project.xml'").join(top, keys, "left_anti")
    return own.unionByName(stand_in.withColumn("path", F.lit("pom.xml")))


def tree(poms: DataFrame, keys: list[str], parents: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges (keys..., parent, child), missing (keys..., parent, child)) of poms (keys..., path, projects); without parents, edges to modules alone.

    A module leads to the build file in its folder, dots in its name standing for folders; a parent's artifact leads from the folder beside it of that name. A file below the
    second level that names a parent counts as its own child, and so is no root. Modules without a file are missing.
    """
    p = F.get("projects", F.lit(0))
    poms = kept(poms.select(*keys, "path", p["modules"]["module"].alias("modules"), p["parent"]["artifactId"].alias("up")), "tree")
    here = poms.select(*keys, F.col("path").alias("found"))
    module = poms.select(*keys, F.col("path").alias("parent"), F.explode("modules").alias("m"))
    base = folder("parent")
    module = module.select(*keys, "parent", F.concat(F.when(base == "", "").otherwise(F.concat(base, F.lit("/"))), F.regexp_replace("m", r"\.", "/"), F.lit("/pom.xml")).alias("child"))
    known = module.join(here.withColumnRenamed("found", "child"), [*keys, "child"], "left_semi").distinct()
    dotted = F.regexp_replace(folder("path"), "/", ".")
    up = poms.where(F.col("up").isNotNull() & (dotted != "")).select(*keys, F.replace("path", dotted, F.col("up")).alias("parent"), F.col("path").alias("child"))
    up = up.join(here.withColumnRenamed("found", "parent"), [*keys, "parent"], "left_semi")
    return known.unionByName(up.select(*known.columns)).distinct() if parents else known, module.join(known, [*keys, "parent", "child"], "left_anti").distinct()


def main_files(poms: DataFrame, keys: list[str], ignored: str = "^$") -> DataFrame:
    """(keys..., path): the files that no other one leads to, less those that match ignored."""
    edges, _ = tree(poms, keys)
    return poms.where(~F.col("path").rlike(ignored)).select(*keys, "path").join(edges.select(*keys, F.col("child").alias("path")), [*keys, "path"], "left_anti")


def own_plugins(p: Column, section: str, managed: bool = False) -> Column:
    at = p[section]["pluginManagement"]["plugins"]["plugin"] if managed else p[section]["plugins"]["plugin"]
    return F.coalesce(at, F.array().cast(f"array<{PLUGINS[len('struct<plugin:array<') : -2]}>"))


def named(name: str):
    return lambda x: x["artifactId"] == name


def field(name: str):
    return lambda x: x[name]


def last(values: Column) -> Column:
    known = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.element_at(known, -1))


def all_of(entries: Column, get) -> Column:
    """The distinct values, sorted, of lists that entries may have."""
    return F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(entries, get), lambda x: x.isNotNull()))))


def relative(path: Column, base: str) -> Column:
    top = base.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substr(path, F.lit(len(top) + 1))).otherwise(path)


def records(rows: DataFrame, base: str = "") -> DataFrame:
    """One row a project of rows (keys..., projects[, xml]): ident and the record of its settings. base is cut from the beginning of folders.

    Whether tools are in use is asked of the whole document, so projects of one document share it; settings of the PMD plugin are those of the reporting and build sections and their managed
    plugins, in this order: later ones win, lists add up. conflict: a source folder of the plugin's own beside another one. rules are with_rules()'s.
    """
    every = F.transform("projects", lambda p: F.concat(own_plugins(p, "build"), own_plugins(p, "reporting"), own_plugins(p, "build", True), own_plugins(p, "reporting", True)))
    whole = rows.withColumn("every", F.flatten(every))
    uses = lambda name: F.exists("every", named(name))
    sonar = F.exists("every", lambda x: F.coalesce(x["groupId"] == SONAR, F.lit(False)))
    prone = F.expr(f"xpath_boolean(xml, '//path[groupId=\"{ERRORPRONE}\"] or //dependency[groupId=\"{ERRORPRONE}\"]')") if "xml" in rows.columns else F.lit(False)
    keys = [c for c in rows.columns if c not in ("projects", "xml", "malformed")]
    flags = whole.where("projects is not null").select(
        *keys, F.explode("projects").alias("p"), uses(PMD).alias("use_pmd"), uses(CHECKSTYLE).alias("use_checkstyle"), uses(FINDBUGS).alias("use_findbugs"), uses(SPOTBUGS).alias("use_spotbugs"), sonar.alias("use_sonarcube"), prone.alias("use_errorprone")
    )
    p = F.col("p")
    order = F.filter(F.concat(own_plugins(p, "reporting"), own_plugins(p, "build"), own_plugins(p, "reporting", True), own_plugins(p, "build", True)), named(PMD))
    flags = flags.withColumn("e", F.when(F.col("use_pmd"), order).otherwise(F.filter(order, lambda x: F.lit(False))))
    e, c = F.col("e"), lambda x: x["configuration"]
    source = last(F.transform(e, lambda x: F.get(c(x)["compileSourceRoots"]["compileSourceRoot"], F.lit(0))))
    tests = last(F.transform(e, lambda x: F.get(c(x)["testSourceRoots"]["testSourceRoot"], F.lit(0))))
    own = relative(p["build"]["sourceDirectory"], base)
    excludes = F.transform(F.flatten(F.transform(all_of(e, lambda x: c(x)["excludes"]["exclude"]), lambda x: F.split(x, ","))), lambda x: F.trim(x))
    count = lambda section: F.when(F.col("use_pmd"), F.size(F.filter(own_plugins(p, section), named(PMD)))).otherwise(0)
    return flags.select(
        *keys, ident(p).alias("ident"), *(f"use_{n}" for n in ("pmd", "checkstyle", "findbugs", "spotbugs", "sonarcube", "errorprone")),
        all_of(e, lambda x: c(x)["rulesets"]["ruleset"]).alias("custom_rule_files"),
        F.array_sort(F.array_distinct(F.transform(all_of(e, lambda x: c(x)["excludeRoots"]["excludeRoot"]), lambda x: relative(x, base)))).alias("exclude_roots"),
        F.array_sort(F.array_distinct(F.filter(excludes, lambda x: x != ""))).alias("excludes"), all_of(e, lambda x: c(x)["includes"]["include"]).alias("includes"),
        F.exists(e, lambda x: F.coalesce(F.lower(c(x)["includeTests"]) == "true", F.lit(False))).alias("include_tests"), all_of(e, lambda x: c(x)["excludeFromFailureFile"]).alias("exclude_from_failure"),
        F.coalesce(F.lower(last(F.transform(e, lambda x: c(x)["language"]))), F.lit("java")).alias("language"), F.coalesce(last(F.transform(e, lambda x: c(x)["minimumPriority"])), F.lit("5")).alias("minimum_priority"),
        F.coalesce(source, own).alias("source_directory"), F.coalesce(tests, relative(p["build"]["testSourceDirectory"], base)).alias("test_source_directory"),
        count("build").alias("plugin_build"), count("reporting").alias("plugin_reporting"), last(F.transform(e, lambda x: x["version"])).alias("version"),
        F.coalesce(own != source, F.lit(False)).alias("conflict"),
    )


def with_rules(records: DataFrame, refs: DataFrame, rulesets: DataFrame, defaults: list[str], keys: list[str]) -> DataFrame:
    """records with rules, and custom_rule_files less those that stand for a whole set.

    A project that uses PMD without rule files of its own has the defaults. A rule file that is given adds the rules that it refers to: refs (keys..., file, ref, excluded) as files.rule_refs() reads
    them, expanded by rulesets (ruleset, rules). One that isn't given is taken for the set of its name, if there is one, and no longer counts as a file, as does one without rules; a file of no known name adds nothing.
    """
    from revlens.operators.builds import expanded_rules

    file = refs.withColumn("ident", F.to_json(F.struct(*keys, "file")))
    names = file.select("ident", *keys, "file").distinct()
    own = names.join(expanded_rules(file, rulesets), "ident", "left").select(*keys, "file", F.coalesce("rules", F.array().cast("array<string>")).alias("of_file"))
    used = records.select(*keys, "ident", F.explode("custom_rule_files").alias("file"))
    category = F.lower(F.split(F.element_at(F.split("file", "/"), -1), r"\.")[0])
    met = used.join(own, [*keys, "file"], "left").withColumn("ruleset", category).join(rulesets.withColumnRenamed("rules", "of_set"), "ruleset", "left")
    met = met.withColumn("added", F.coalesce("of_file", "of_set", F.array().cast("array<string>"))).withColumn("stays", F.when(F.col("of_file").isNotNull(), F.size("of_file") > 0).otherwise(F.col("of_set").isNull()))
    each = met.groupBy(*keys, "ident").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("added")))).alias("custom"), F.array_sort(F.collect_set(F.when(F.col("stays"), F.col("file")))).alias("files"))
    rules = F.when(~F.col("use_pmd"), F.array().cast("array<string>")).when(F.size("custom_rule_files") == 0, F.lit(sorted(set(defaults)))).otherwise(F.col("custom"))
    out = records.join(each, [*keys, "ident"], "left").withColumn("rules", rules)
    return out.withColumn("custom_rule_files", F.coalesce("files", "custom_rule_files")).drop("custom", "files")


# ---------------------------------------------------------------- effective projects


def first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def merged_plugins(line: Column, section: str, managed: bool) -> Column:
    """The plugins of a section over a line of projects, the nearest first: of each plugin the nearest setting counts, field by field; what a parent doesn't let inherit is left out. Plugins of the build take what they lack from managed ones."""
    of = lambda m: F.flatten(F.transform(line, lambda p, i: F.filter(own_plugins(p, section, m), lambda x: (i == 0) | ~F.coalesce(x["inherited"] == "false", F.lit(False)))))
    name = lambda x: F.concat(F.coalesce(x["groupId"], F.lit("org.apache.maven.plugins")), F.lit(":"), x["artifactId"])
    own = of(managed)
    pool = F.concat(own, of(True)) if section == "build" and not managed else own

    def merge(key):
        xs = F.filter(pool, lambda x: name(x) == key)
        c = lambda get: first(F.transform(xs, lambda x: get(x["configuration"])))
        deep = [(a, b) for a, b in (("compileSourceRoots", "compileSourceRoot"), ("testSourceRoots", "testSourceRoot"), ("rulesets", "ruleset"), ("excludeRoots", "excludeRoot"), ("excludes", "exclude"), ("includes", "include"))]
        got = {a: F.struct(c(lambda x, a=a, b=b: x[a][b]).alias(b)).alias(a) for a, b in deep}
        flat = {a: c(lambda x, a=a: x[a]).alias(a) for a in ("minimumPriority", "language", "includeTests", "excludeFromFailureFile")}
        order = ("minimumPriority", "language", "compileSourceRoots", "testSourceRoots", "includeTests", "excludeFromFailureFile", "rulesets", "excludeRoots", "excludes", "includes")
        settings = F.struct(*((got | flat)[a] for a in order)).alias("configuration")
        return F.struct(*(first(F.transform(xs, field(f))).alias(f) for f in ("groupId", "artifactId", "version", "inherited")), settings)

    return F.transform(F.array_distinct(F.transform(own, name)), merge)


def replaced(text: Column, entries: Column) -> Column:
    """text with each ${key} of entries (key, value) put in."""
    return F.aggregate(entries, text, lambda t, e: F.replace(t, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))


def ancestors(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., path, up, depth): each file's line of parents, itself at depth 0, along links (keys..., path, up). A line that comes back to itself ends there."""
    found = [kept(links.select(*keys, "path", F.col("path").alias("up"), F.lit(0).alias("depth")), "ancestors")]
    step = links.where("up is not null").select(*keys, F.col("path").alias("up"), F.col("up").alias("next"))
    while True:
        seen = reduce(DataFrame.unionByName, found)
        more = found[-1].join(step, [*keys, "up"]).select(*keys, "path", F.col("next").alias("up"), (F.col("depth") + 1).alias("depth"))
        more = kept(more.join(seen.select(*keys, "path", "up"), [*keys, "path", "up"], "left_anti"), "ancestors")
        if more.isEmpty():
            return seen
        found.append(more)


def effective(poms: DataFrame, keys: list[str], base: str = "", rewrites: DataFrame | None = None) -> DataFrame:
    """(keys..., path, projects, error): the effective project of each of poms (keys..., path, xml), from these files alone.

    Parents are found by group, artifact and version. Group, version, properties and plugins come down from them; the nearest setting counts. ${...} is put in from properties and the project's
    own values, properties of properties included; what is nowhere defined stays. Folders are made absolute below base. error: malformed, parent (a parent that isn't among the
    files, or is in error itself) or child (a module that isn't); projects is null then. rewrites (group, artifact, version, new_version): parents that aren't found are looked for once more as rewritten_parents() has them.
    """
    read = kept(parsed(poms.select(*keys, "path", "xml")).select(*keys, "path", "malformed", F.get("projects", F.lit(0)).alias("p"), "projects"), "poms")
    p = F.col("p")
    group, version = F.coalesce(p["groupId"], p["parent"]["groupId"]), F.coalesce(p["version"], p["parent"]["version"])
    known = read.where("not malformed").groupBy(*keys, group.alias("g"), p["artifactId"].alias("a"), version.alias("v")).agg(F.min("path").alias("up"))
    want = read.select(*keys, "path", p["parent"]["groupId"].alias("g"), p["parent"]["artifactId"].alias("a"), p["parent"]["version"].alias("v"), p["parent"]["relativePath"].alias("relative"), (F.col("p").isNotNull() & p["parent"].isNotNull()).alias("has"))
    found = want.join(known, [*keys, "g", "a", "v"], "left")
    if rewrites is not None:
        from revlens.operators.builds import rewritten_parents

        name = F.to_json(F.struct(*keys, "path"))
        lost = found.where("has and up is null")
        again = rewritten_parents(lost.select(name.alias("pom"), F.col("g").alias("group"), F.col("a").alias("artifact"), F.col("v").alias("version"), "relative"), rewrites)
        again = lost.select(*keys, "path", name.alias("pom")).join(again, "pom").select(*keys, "path", F.col("group").alias("g"), F.col("artifact").alias("a"), F.col("version").alias("v"))
        better = again.join(known, [*keys, "g", "a", "v"]).select(*keys, "path", F.col("up").alias("other"))
        found = found.join(better, [*keys, "path"], "left").withColumn("up", F.coalesce("up", "other")).drop("other")
    links = kept(found.select(*keys, "path", "up", (F.col("has") & F.col("up").isNull()).alias("lost")), "links")
    line = ancestors(links, keys)
    each = line.join(read.select(*keys, F.col("path").alias("up"), "p", "malformed"), [*keys, "up"]).join(links.select(*keys, F.col("path").alias("up"), "lost"), [*keys, "up"])
    whole = each.groupBy(*keys, "path").agg(F.array_sort(F.collect_list(F.struct("depth", F.struct(*(p[f].alias(f) for f in FIELDS if f != "properties"), F.map_entries(p["properties"]).alias("properties")).alias("p")))).alias("line"), F.max("lost").alias("lost"), F.max("malformed").alias("malformed"))
    whole = whole.withColumn("line", F.transform("line", lambda x: x["p"]))
    _, missing = tree(read, keys)
    whole = whole.join(missing.select(*keys, F.col("parent").alias("path"), F.lit(True).alias("childless")).distinct(), [*keys, "path"], "left")
    ln = F.col("line")
    here = F.when(folder("path") == "", F.lit(base.rstrip("/"))).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), folder("path")))
    me = F.get(ln, F.lit(0))
    whole = whole.withColumn("g", first(F.transform(ln, lambda x: F.coalesce(x["groupId"], x["parent"]["groupId"])))).withColumn("v", first(F.transform(ln, lambda x: F.coalesce(x["version"], x["parent"]["version"]))))
    own = {"project.groupId": F.col("g"), "project.artifactId": me["artifactId"], "project.version": F.col("v"), "project.basedir": here, "basedir": here, "project.parent.version": me["parent"]["version"], "project.parent.groupId": me["parent"]["groupId"]}
    own |= {k.replace("project.", "pom."): c for k, c in own.items() if k.startswith("project.")} | {"version": F.col("v")}
    entries = F.flatten(F.transform(ln, lambda x: F.coalesce(x["properties"], F.array().cast("array<struct<key:string,value:string>>"))))
    entries = F.concat(entries, F.filter(F.array(*(F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in own.items())), lambda x: x["value"].isNotNull()))
    whole = whole.withColumn("all", F.filter(entries, lambda x: x["value"].isNotNull()))
    whole = whole.withColumn("props", F.transform(F.array_distinct(F.transform("all", lambda x: x["key"])), lambda k: F.struct(k.alias("key"), F.get(F.filter("all", lambda x: x["key"] == k), F.lit(0))["value"].alias("value")))).drop("all")
    whole = kept(spread(whole), "lines")
    many = whole.agg(F.max(F.size("props"))).first()[0] or 0
    for _ in range(many.bit_length()):  # each round doubles how deep references are followed
        whole = kept(spread(whole).withColumn("props", F.transform("props", lambda e: F.struct(e["key"], replaced(e["value"], F.col("props")).alias("value")))), "lines")
    ln = F.col("line")
    plugins = lambda s, m: F.struct(merged_plugins(ln, s, m).alias("plugin"))
    section = lambda s: [plugins(s, False).alias("plugins"), F.struct(plugins(s, True).alias("plugins")).alias("pluginManagement")]
    place = lambda f, default: F.coalesce(first(F.transform(ln, lambda x: x["build"][f])), F.lit(default)).alias(f)
    me = F.get(ln, F.lit(0))
    built = F.struct(F.col("g").alias("groupId"), me["artifactId"].alias("artifactId"), F.col("v").alias("version"), me["parent"].alias("parent"), me["modules"].alias("modules"), F.map_from_entries("props").alias("properties"),
                     F.struct(place("sourceDirectory", SOURCES), place("testSourceDirectory", TEST_SOURCES), *section("build")).alias("build"), F.struct(*section("reporting")).alias("reporting"))
    escaped = F.transform("props", lambda e: F.struct(e["key"], F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')).alias("value")))
    text = replaced(F.to_json(built), escaped)
    error = F.when(F.col("malformed"), "malformed").when(F.col("lost"), "parent").when(F.col("childless"), "child")
    # written, so that merging and reading back are done once, whatever is asked of the project
    out = kept(spread(whole).select(*keys, "path", error.alias("error"), here.alias("here"), text.alias("text")), "merged").withColumn("p", F.from_json("text", PROJECT))
    here = F.col("here")
    full = lambda f: F.when(F.col("p")["build"][f].startswith("/"), F.col("p")["build"][f]).otherwise(F.concat(here, F.lit("/"), F.col("p")["build"][f]))
    put = F.col("p").withField("build.sourceDirectory", full("sourceDirectory")).withField("build.testSourceDirectory", full("testSourceDirectory"))
    return kept(spread(out).select(*keys, "path", F.when(F.col("error").isNull(), F.array(put)).alias("projects"), "error"), "projects")


def without_doubles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys..., path, ident, ...) less the files that share an ident with others, but for the shortest of all such files."""
    shared = rows.groupBy(*keys, "ident").agg(F.count_distinct("path").alias("n"), F.collect_set("path").alias("paths")).where("n > 1")
    double = shared.select(*keys, F.explode("paths").alias("path")).distinct()
    keep = double.groupBy(*keys).agg(F.min_by("path", F.struct(F.length("path").alias("n"), F.col("path"))).alias("path"))
    return rows.join(double.join(keep, [*keys, "path"], "left_anti"), [*keys, "path"], "left_anti")


def built(files: DataFrame, keys: list[str], ignored: str = "^$", rewrites: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of the build of each tree of files (keys..., path, xml): records() of the projects that its main files lead to by modules, with their path; errors (keys..., error), one a tree whose build can't be made.

    A tree is in error if one of these projects is, or if any file is malformed. Files whose projects others have too are left out as without_doubles() says.
    """
    own = with_stand_in(files, keys)
    read = kept(parsed(own), "read")
    main = main_files(read, keys, ignored)
    edges, _ = tree(read, keys, parents=False)
    found = [kept(main, "main")]
    while True:
        seen = reduce(DataFrame.unionByName, found)
        more = found[-1].join(edges.withColumnRenamed("parent", "path"), [*keys, "path"]).select(*keys, F.col("child").alias("path")).distinct()
        more = kept(more.join(seen, [*keys, "path"], "left_anti"), "main")
        if more.isEmpty():
            break
        found.append(more)
    out = kept(effective(own, keys, rewrites=rewrites).join(seen, [*keys, "path"], "left_semi"), "effective")
    bad = out.where("error is not null").select(*keys, "error").unionByName(read.where("malformed").select(*keys, F.lit("malformed").alias("error")))
    errors = bad.groupBy(*keys).agg(F.max("error").alias("error"))
    fine = out.where("error is null").join(errors, keys, "left_anti").drop("error").join(own.select(*keys, "path", "xml"), [*keys, "path"])
    return without_doubles(records(fine), keys), errors
