"""All queries of the library by name, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks, corpus, forms, learning, lines, preprocess, procedures, programs, references, search, stored, structure, trees

_MODULES = [corpus, search, checks, structure, programs, learning, lines, preprocess, procedures, references, stored, trees, forms]
_ALL = {name: made for module in _MODULES for name, made in module.QUERIES.items()}
if len(_ALL) < sum(len(m.QUERIES) for m in _MODULES):
    raise ValueError("two queries have one name")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search over documents by query words, category and name."""
    return search.enhanced_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
