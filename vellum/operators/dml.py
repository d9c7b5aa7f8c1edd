"""Data changes as pure functions: (current rows, arguments) -> the table after the statement, or its edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.overlay import same_key


def insert(current: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows added; keys are checked by vellum.operators.constraints before."""
    return current.unionByName(rows.select(*current.columns))


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_ignore(current: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Adds the rows whose key is new; of several new rows with one key, the first in the given order."""
    fresh = first_per_key(rows, key, order)
    return current.unionByName(fresh.join(current, same_key(fresh, current, key), "left_anti").select(*current.columns))


def upsert(current: DataFrame, rows: DataFrame, key: Sequence[str], updates: Mapping[str, str]) -> DataFrame:
    """INSERT ... ON DUPLICATE KEY UPDATE. In updates, ``c`` is the present value and ``new.c`` the value of the inserted row."""
    old, new = current.alias("old"), rows.alias("new")
    both = old.join(new, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key], "full_outer")
    is_new, is_old = F.col(f"old.{key[0]}").isNull(), F.col(f"new.{key[0]}").isNull()
    out = []
    for c in current.columns:
        present = F.col(f"old.{c}")
        changed = F.expr(_qualify(updates[c], current.columns)) if c in updates else present
        out.append(F.when(is_new, F.col(f"new.{c}")).when(is_old, present).otherwise(changed).cast(current.schema[c].dataType).alias(c))
    return both.select(*out)


def _qualify(text: str, columns: Sequence[str]) -> str:
    import re

    names = "|".join(re.escape(c) for c in sorted(columns, key=len, reverse=True))
    return re.sub(rf"(?<![\w.`'])({names})(?![\w`'(])", r"old.\1", text)


def update(current: DataFrame, where: Column | str, assignments: Mapping[str, Column | str]) -> DataFrame:
    """The table after UPDATE ... SET ... WHERE; rows for which the condition is unknown stay."""
    hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    value = lambda v: F.expr(v) if isinstance(v, str) else v
    columns = [F.when(hit, value(assignments[f.name])).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in assignments else F.col(f.name) for f in current.schema]
    return current.select(*columns)


def update_pairs(current: DataFrame, where: Column | str, assignments: Mapping[str, Column | str]) -> DataFrame:
    """old and new (structs) of the rows that an update really changes."""
    hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    value = lambda v: F.expr(v) if isinstance(v, str) else v
    new = [(value(assignments[f.name]).cast(f.dataType) if f.name in assignments else F.col(f.name)).alias(f.name) for f in current.schema]
    pairs = current.where(hit).select(F.struct(*current.columns).alias("old"), F.struct(*new).alias("new"))
    return pairs.where(~F.col("old").eqNullSafe(F.col("new")))


def delete(current: DataFrame, where: Column | str) -> DataFrame:
    hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    return current.where(~hit)


def with_defaults(rows: DataFrame, defaults: Mapping[str, str], columns: Sequence[str], types: Mapping[str, object]) -> DataFrame:
    """Rows that name some columns, filled up by stored default expressions (or null)."""
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.expr(defaults.get(c, "NULL")).cast(types[c])).alias(c) for c in columns])
