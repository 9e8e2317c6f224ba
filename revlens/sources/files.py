"""Readers of tool output: PMD CSV, Pylint JSON, line counts, build files, document-store exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.columns import code_line

PMD = "Problem string, Package string, File string, Priority string, Line int, Description string, `Rule set` string, Rule string"
PYLINT = "type string, module string, obj string, line int, column int, path string, symbol string, message string, `message-id` string"


def pmd(spark: SparkSession, at: str, base: str = "") -> DataFrame:
    """(file, line, rule) of a PMD report; base is cut from paths."""
    rows = spark.read.csv(at, header=True, quote='"', escape='"', schema=PMD)
    return rows.select(F.regexp_replace("File", f"^{base}", "").alias("file") if base else F.col("File").alias("file"), F.col("Line").alias("line"), F.col("Rule").alias("rule"))


def pylint(spark: SparkSession, at: str) -> DataFrame:
    rows = spark.read.schema(PYLINT).json(at, multiLine=True)
    return rows.select(F.col("path").alias("file"), "line", F.col("message-id").alias("rule"))


def code_lines(spark: SparkSession, at: str, extension: str, comment: str = r"^(//|/\*|\*|#)") -> DataFrame:
    """(file, lloc): lines of code of the files with an extension."""
    rows = spark.read.option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", True).text(at).select(F.input_file_name().alias("file"), "value")
    return rows.groupBy("file").agg(F.count(F.when(code_line(F.col("value"), comment), 1)).alias("lloc"))


def build_files(texts: DataFrame) -> DataFrame:
    """One row a build file (pom, xml): identity, parent, modules, source folder, plugins and their own rule sets.

    Missing parts of an identity are 'unknown'; group and version are the parent's where the file has none.
    """
    one = lambda p: F.expr(f"xpath_string(xml, '{p}')")
    many = lambda p: F.expr(f"xpath(xml, '{p}/text()')")
    part = lambda *ps: F.coalesce(*(F.nullif(one(p), F.lit("")) for p in ps), F.lit("unknown"))
    ident = F.concat(part("project/groupId", "project/parent/groupId"), F.lit(":"), part("project/artifactId"), F.lit("-"), part("project/version", "project/parent/version"))
    parent = F.concat(part("project/parent/groupId"), F.lit(":"), part("project/parent/artifactId"), F.lit("-"), part("project/parent/version"))
    plugins = many("project/build/plugins/plugin/artifactId")
    reports = many("project/reporting/plugins/plugin/artifactId")
    every = F.concat(plugins, reports)
    uses = lambda name: F.array_contains(every, name)
    rules = F.concat(many("project/build/plugins/plugin/configuration/rulesets/ruleset"), many("project/reporting/plugins/plugin/configuration/rulesets/ruleset"))
    return texts.select(
        "pom",
        ident.alias("ident"),
        F.when(F.expr("xpath_boolean(xml, 'project/parent')"), parent).alias("parent"),
        many("project/modules/module").alias("modules"),
        F.coalesce(F.nullif(one("project/build/sourceDirectory"), F.lit("")), F.lit("src/main/java")).alias("source_directory"),
        uses("maven-pmd-plugin").alias("use_pmd"),
        uses("maven-checkstyle-plugin").alias("use_checkstyle"),
        uses("findbugs-maven-plugin").alias("use_findbugs"),
        (F.size(rules) > 0).alias("use_custom_rules"),
        rules.alias("rulesets"),
    )


def rule_refs(texts: DataFrame) -> DataFrame:
    """(ident, ref, excluded) of rule set files (ident, xml), one row for each rule that refers to another."""
    rules = F.regexp_extract_all("xml", F.lit(r"(?s)(<rule\b[^>]*?(?:/>|>.*?</rule>))"), F.lit(1))  # a row each, so that an exclude belongs to its own rule
    rows = texts.select("ident", F.explode(rules).alias("rule"))
    return rows.select("ident", F.expr("xpath_string(rule, 'rule/@ref')").alias("ref"), F.expr("xpath(rule, 'rule/exclude/@name')").alias("excluded")).where("ref <> ''")


def documents(spark: SparkSession, at: str, model: str, schema) -> DataFrame:
    """The documents of one model of an export {"collections": [{"model", "documents"}]}."""
    text = spark.read.text(at, wholetext=True)
    rows = text.select(F.explode(F.expr("from_json(get_json_object(value, '$.collections'), 'array<struct<model:string,documents:string>>')")).alias("c"))
    own = rows.where(F.col("c.model") == model)
    return own.select(F.explode(F.from_json("c.documents", f"array<struct<{schema}>>")).alias("d")).select("d.*")
