"""All queries of the library, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import landed, ledger, markup, pages, postings, runs

_ALL = pages.QUERIES | markup.QUERIES | postings.QUERIES | runs.QUERIES | ledger.QUERIES | landed.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """SQL exists for all queries but those that read HTML as a tree, iterate, or compare fuzzily."""
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
