"""Changes of a table's form as pure functions: the rows of the table after ALTER."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def placed(columns: Sequence[str], name: str, first: bool = False, after: str | None = None) -> list[str]:
    """Column order with name put first, after another, or last."""
    rest = [c for c in columns if c != name]
    at = 0 if first else rest.index(after) + 1 if after else len(rest)
    return [*rest[:at], name, *rest[at:]]


def add_column(df: DataFrame, name: str, kind: str, default: str | None = None, first: bool = False, after: str | None = None) -> DataFrame:
    made = df.withColumn(name, F.expr(default or "NULL").cast(kind))
    return made.select(*placed(df.columns, name, first, after))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def modify_column(df: DataFrame, name: str, kind: str, first: bool = False, after: str | None = None) -> DataFrame:
    """The column converted by an ANSI cast, which fails on a value that does not fit."""
    made = df.withColumn(name, F.col(name).cast(kind))
    return made.select(*placed(df.columns, name, first, after)) if first or after else made
