"""Columns by their exact names, whatever characters these hold."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F


def named(name: str) -> Column:
    """The column of that name; dots and backticks are part of it."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame, without: Collection[str] = ()) -> Column:
    """All columns as one struct."""
    return F.struct(*[named(c).alias(c) for c in df.columns if c not in without])


def by_place(df: DataFrame) -> DataFrame:
    """The rows with columns c0, c1 and so on, for functions that look columns up by name."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])
