"""Linters by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.sources import files

#: Readers of each linter's report: (session, place) to (file, line, rule).
CONNECTORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pmd": files.pmd, "pylint": files.pylint}
#: The linter of each language.
OF_LANGUAGE = {"java": "pmd", "python": "pylint"}


def connector(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The reader of a linter, or of the linter of a language."""
    name = OF_LANGUAGE.get(name, name)
    if name not in CONNECTORS:
        raise ValueError(f"connector: {name} is none of {sorted(CONNECTORS)}")
    return CONNECTORS[name]
