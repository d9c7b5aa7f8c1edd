"""Constraint checks as plans that return the violating rows or keys; nothing is collected to find them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.overlay import same_key


def any_null(columns: Sequence[str]) -> Column:
    """Is one of the columns null?"""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return bad


def any_nan(df: DataFrame, columns: Sequence[str]) -> Column:
    """Is one of the columns, if it is floating, NaN?"""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")}
    bad = F.lit(False)
    for c in columns:
        if c in floats:
            bad = bad | F.isnan(c)
    return bad


def null_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that are null in one of the columns."""
    return df.where(any_null(columns))


def nan_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with NaN in a floating key column."""
    return df.where(any_nan(df, columns))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number (n)."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Duplicated values of a unique key; rows with a null in it never clash."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return duplicate_keys(df.where(whole), columns)


def check_violations(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which a check is false; an unknown result passes."""
    return df.where(~F.coalesce(F.expr(predicate), F.lit(True)))


def existing_keys(new: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of new whose key is in current already."""
    return new.join(current, same_key(new, current, key), "left_semi")
