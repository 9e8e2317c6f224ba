"""Column functions of the model: names, filters, predicates, ratios (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.constants import BUILD_ERRORS

#: The extensions of each language.
EXTENSIONS = {"java": ".java", "python": ".py"}


def safe_ratio(x: Column, y: Column) -> Column:
    """x/y where y is positive, else 0."""
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, as SQL engines that multiply by a power of ten, round and divide give it; Spark's round() takes the decimal digits instead, which differs where the product meets a tie. What is below 0 and becomes 0 keeps its sign (-0.0)."""
    y = F.round(x * 10.0**digits, 0) / 10.0**digits
    return F.when((x < 0) & (y == 0), F.lit(-0.0)).otherwise(y)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down (so -22 hours are -1)."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")


def subsystem(path: Column) -> Column:
    """The folders of a path, '' at the top."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def directory(path: Column) -> Column:
    """The folder that holds the file, '/' at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("/"))


def python_file(path: Column, production_only: bool = True) -> Column:
    ok = F.lower(path).endswith(".py")
    if production_only:
        ok = ok & ~F.lower(path).contains("/test/") & ~F.lower(path).contains("/tests/")
    return ok


def java_file(path: Column, production_only: bool = True, excluded: str = r"(^|/)(test|tests|examples?)/") -> Column:
    """excluded is a parameter: the rule is the project's own."""
    ok = F.lower(path).endswith(".java")
    return ok & ~F.lower(path).rlike(excluded) if production_only else ok


def language_file(language: str, path: Column, production_only: bool = True) -> Column:
    if language not in EXTENSIONS:
        return F.lit(False)
    return (python_file if language == "python" else java_file)(path, production_only)


def effective_change(kind: Column, old_ok: Column, new_ok: Column) -> Column:
    """What a change means where just some paths are tracked: a rename out of them deletes, one into them adds; null: nothing."""
    rename = F.when(old_ok & new_ok, F.lit("RENAME")).when(old_ok, F.lit("DELETE")).when(new_ok, F.lit("ADD"))
    other = F.when(F.coalesce(old_ok, F.lit(True)) & F.coalesce(new_ok, F.lit(True)), kind)
    return F.when(kind == "RENAME", rename).otherwise(other)


def file_name(kind: Column, old: Column, new: Column) -> Column:
    return F.when(kind == "DELETE", old).otherwise(new)


def any_substring(text: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.lower(text).contains(k)
    return F.coalesce(out, F.lit(False))


def any_token(text: Column, keywords: list[str]) -> Column:
    """A keyword as a whole token, in lines that aren't trailers; one of several words never matches."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda x: ~x.startswith("git-svn-id") & ~x.startswith("signed-off"))
    tokens = F.split(F.array_join(lines, " "), r"\s+")
    return F.coalesce(F.arrays_overlap(tokens, F.array(*map(F.lit, keywords))), F.lit(False))


def issue_keys(text: Column, key: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({key}-[0-9]+)"), F.lit(1))


def code_line(text: Column, comment: str = r"^(//|/\*|\*|#)") -> Column:
    """Neither blank nor a comment; comment is a parameter."""
    t = F.trim(text)
    return (t != "") & ~t.rlike(comment)


def build_error(output: Column, kinds=BUILD_ERRORS) -> Column:
    """The last kind whose words the output holds, else unknown."""
    out = F.lit("unknown")
    for name, words in kinds:
        out = F.when(output.contains(words), F.lit(name)).otherwise(out)
    return out
