"""Differences and three-way merges of tables by primary key.

Rows are indivisible: a row is compared as a struct, null-safe, and an absent row is a null struct, so a row of nulls is not
taken for an absent one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL, REMOTE, BASE, DELETE = "local", "remote", "base", "delete"


def packed(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Key columns and the row as a struct."""
    return df.select(*[F.col(k) for k in key], F.struct(*df.columns).alias(name))


def _outer(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    return left.join(right, list(key), "full_outer")


def diff_rows(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key, change (added, deleted, modified), old and new of every row that differs."""
    both = _outer(packed(old, key, "old"), packed(new, key, "new"), key).where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified")
    return both.select(*key, change.alias("change"), "old", "new")


def row_digest(df: DataFrame) -> Column:
    """A hash of a row that tells nulls from values and their places."""
    return F.xxhash64(*[x for c in df.columns for x in (F.col(c).isNull(), F.col(c))])


def content_hash(df: DataFrame) -> DataFrame:
    """One row: the number of rows and order-free sums of their hashes; equal tables give equal rows."""
    h = row_digest(df)
    return df.select(h.alias("h")).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.col("h").bitwiseAND(F.lit(0x7FFFFFFF))), F.lit(0)).alias("low"),
        F.coalesce(F.sum(F.shiftright("h", 32)), F.lit(0)).alias("high"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mixed"),
    )


def aligned(base: DataFrame, local: DataFrame, remote: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key, b, l, r of every key on any side, and outcome: the side to take, or conflict."""
    rows = _outer(_outer(packed(base, key, "b"), packed(local, key, "l"), key), packed(remote, key, "r"), key)
    b, le, r = F.col("b"), F.col("l"), F.col("r")
    outcome = F.when(le.eqNullSafe(r), LOCAL).when(le.eqNullSafe(b), REMOTE).when(r.eqNullSafe(b), LOCAL).otherwise("conflict")
    return rows.withColumn("outcome", outcome)


def _unpacked(rows: DataFrame, value: Column, columns: Sequence[str]) -> DataFrame:
    picked = rows.select(value.alias("_v")).where(F.col("_v").isNotNull())
    return picked.select(*[F.col("_v").getField(c).alias(c) for c in columns])


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows that merge without a conflict."""
    rows = aligned(base, local, remote, key).where("outcome <> 'conflict'")
    return _unpacked(rows, F.when(F.col("outcome") == LOCAL, F.col("l")).otherwise(F.col("r")), base.columns)


def conflicts(base: DataFrame, local: DataFrame, remote: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key, b, l, r of the keys that both sides changed differently."""
    return aligned(base, local, remote, key).where("outcome = 'conflict'").drop("outcome")


def conflict_id(table: str, key: Sequence[str]) -> Column:
    """row:<table>:<base64 of the key as JSON>"""
    return F.concat(F.lit(f"row:{table}:"), F.base64(F.to_json(F.struct(*key)).cast("binary")))


def resolved(base: DataFrame, local: DataFrame, remote: DataFrame, key: Sequence[str], resolutions: DataFrame) -> DataFrame:
    """The merge with resolutions: key columns and resolution (local, remote, base or delete). Unresolved conflicts are left out."""
    rows = aligned(base, local, remote, key).join(resolutions.select(*key, "resolution"), list(key), "left")
    take = F.when(F.col("outcome") == "conflict", F.col("resolution")).otherwise(F.col("outcome"))
    value = F.when(take == LOCAL, F.col("l")).when(take == REMOTE, F.col("r")).when(take == BASE, F.col("b"))
    return _unpacked(rows, value, base.columns)
