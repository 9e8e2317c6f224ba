"""Queries on build files: each part is a project whose parent has its number without the last digit."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import poms
from revlens.plans import analog as A
from revlens.plans.queries import query

K = ["rev"]


def files(spark, d):
    """(rev, path, xml): every third part has a property, every fourth the plugin, some name a parent that isn't there."""
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = lambda *cs: F.concat(*(F.lit(c) if isinstance(c, str) else c.cast("string") for c in cs))
    up = F.when(n % 50 == 7, F.lit("gone")).otherwise(text("a", F.floor(n / 10)))
    parent = F.when(n >= 10, text("<parent><groupId>g</groupId><artifactId>", up, "</artifactId><version>1</version></parent>")).otherwise("")
    held = F.when(n % 3 == 0, text("<properties><size>", size, "</size></properties>")).otherwise("")
    rules = text("<rulesets><ruleset>${basedir}/", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), ".xml</ruleset></rulesets>")
    plugin = text("<plugin><artifactId>maven-pmd-plugin</artifactId><version>${size}</version><configuration><minimumPriority>", n % 5, "</minimumPriority>", rules, "</configuration></plugin>")
    build = F.when(n % 4 == 0, text("<build><plugins>", plugin, "</plugins></build>")).otherwise("")
    xml = text('<project xmlns="http://maven.apache.org/POM/4.0.0">', parent, "<groupId>g</groupId><artifactId>a", n, "</artifactId><version>1</version>", held, build, "</project>")
    return A.table(spark, d, "part").select(F.lit("r").alias("rev"), text("a", n, "/pom.xml").alias("path"), xml.alias("xml"), "p_partkey")


LINE = """
p AS (SELECT *, p_partkey AS n, CASE WHEN p_partkey >= 10 AND p_partkey % 50 <> 7 AND p_partkey // 10 IN (SELECT p_partkey FROM part) THEN p_partkey // 10 END AS up FROM part),
line(n, up_, depth) AS (SELECT n, n, 0 FROM p UNION ALL SELECT l.n, p.up, depth + 1 FROM line l JOIN p ON p.n = l.up_ WHERE p.up IS NOT NULL)"""


@query("s12_main_files", f"WITH RECURSIVE {LINE} SELECT 'a' || n || '/pom.xml' AS path FROM p WHERE up IS NULL")
def s12_main_files(spark, d):
    return poms.main_files(poms.parsed(files(spark, d)), K).select("path")


@query("s13_effective", f"""WITH RECURSIVE {LINE},
met AS (SELECT line.n, bool_or(p.n >= 10 AND p.up IS NULL) AS lost, arg_min(p_size, depth) FILTER (p.n % 3 = 0) AS size, arg_min(p.n % 5, depth) FILTER (p.n % 4 = 0) AS priority,
  arg_min(lower(replace(p_brand, '#', '')), depth) FILTER (p.n % 4 = 0) AS brand FROM line JOIN p ON p.n = line.up_ GROUP BY line.n)
SELECT 'a' || n || '/pom.xml' AS path, CASE WHEN lost THEN 'parent' END AS error, (NOT lost AND priority IS NOT NULL) AS use_pmd, CASE WHEN NOT lost THEN coalesce(priority::VARCHAR, '5') END AS minimum_priority,
  CASE WHEN NOT lost AND priority IS NOT NULL THEN coalesce(size::VARCHAR, '${{size}}') END AS version, CASE WHEN NOT lost AND priority IS NOT NULL THEN '/a' || n || '/' || brand || '.xml' END AS rules,
  CASE WHEN NOT lost THEN 'a' || n || '/src/main/java' END AS source_directory FROM met""")
def s13_effective(spark, d):
    """Settings and properties come down the line of parents; a line that ends at a missing parent is in error."""
    built = poms.effective(files(spark, d), K)
    rec = poms.records(built.drop("error")).select("path", "use_pmd", "minimum_priority", "version", F.get("custom_rule_files", F.lit(0)).alias("rules"), "source_directory")
    return built.select("path", "error").join(rec, "path", "left").na.fill(False, ["use_pmd"])


@query("s14_records", "SELECT 'g:a' || p_partkey || '-1' AS ident, p_partkey % 4 = 0 AS use_pmd, CASE WHEN p_partkey % 4 = 0 THEN (p_partkey % 5)::VARCHAR ELSE '5' END AS minimum_priority, CASE WHEN p_partkey % 4 = 0 THEN '${size}' END AS version, (p_partkey % 4 = 0)::INT AS plugin_build, 0 AS plugin_reporting, 'java' AS language, CASE WHEN p_partkey % 4 = 0 THEN '${basedir}/' || lower(replace(p_brand, '#', '')) || '.xml' ELSE '' END AS rules FROM part")
def s14_records(spark, d):
    """The files as a tool prints them, lines of its own around them."""
    printed = F.concat(F.lit('[INFO] begins\n<?xml version="1.0"?>\n'), F.replace("xml", F.lit("</project>"), F.lit("\n</project>")), F.lit("\n[INFO] ends"))
    rows = poms.records(poms.parsed(files(spark, d).select("path", poms.document(printed).alias("xml"))))
    return rows.select("ident", "use_pmd", "minimum_priority", "version", "plugin_build", "plugin_reporting", "language", F.array_join("custom_rule_files", ",").alias("rules"))
