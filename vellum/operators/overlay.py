"""Merge-on-read: a base table under batches of edits, newest first.

An edit has the table's columns, ``_op`` ("put" or "del") and a position: ``_generation`` and ``_seq``. Values of a deleted row
are null but for its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = ("_op", "_generation", "_seq")


def same_key(left: DataFrame, right: DataFrame, key: Sequence[str]):
    """A null-safe equality of key columns of two frames."""
    out = None
    for k in key:
        one = left[k].eqNullSafe(right[k])
        out = one if out is None else out & one
    return out


def by_rows(side: DataFrame, n: int) -> DataFrame:
    """A side of a join with n rows at most. Spark guesses its size by the bytes of files, and well compressed ones can hold millions of
    rows in what it would broadcast through the driver; where n rows are more than it may, the join is one of sorted sides."""
    limit = side._jdf.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    return side.hint("merge") if n * (8 + side._jdf.schema().defaultSize()) > limit else side


def latest_per_key(edits: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last edit of each key by (generation, seq): one aggregation, combined before the shuffle."""
    whole = F.struct(*[F.col(c) for c in edits.columns])
    newest = edits.groupBy(*key).agg(F.max_by(whole, F.struct("_generation", "_seq")).alias("_e"))
    return newest.select("_e.*")


def overlay(base: DataFrame, edits: DataFrame, key: Sequence[str], n: int = 0) -> DataFrame:
    """base with edits applied: keys that were edited leave the base, live edits join it. n: of edits, at most, where it is known."""
    newest = latest_per_key(edits, key)
    kept = base.join(by_rows(newest.select(*key), n), list(key), "left_anti").select(*base.columns)
    return kept.unionByName(newest.where(F.col("_op") == "put").select(*base.columns))


def as_edits(rows: DataFrame, op: str, generation: int = 0, seq: int = 0) -> DataFrame:
    return rows.select("*", F.lit(op).alias("_op"), F.lit(generation).cast("long").alias("_generation"), F.lit(seq).cast("long").alias("_seq"))


def deletions(keys: DataFrame, like: DataFrame, key: Sequence[str], generation: int = 0, seq: int = 0) -> DataFrame:
    """Tombstones with the columns of like."""
    columns = [F.col(f.name) if f.name in key else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema]
    return as_edits(keys.select(*columns), "del", generation, seq)
