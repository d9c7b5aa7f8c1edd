"""Numbers of pairs, found from the sizes of groups; no pair is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def others_in_group(rows: DataFrame, key: str, group: str, a: str, n: str) -> DataFrame:
    """For each key (as a) the number (as n) of pairs of one of its rows with a row of another key in the same group: what a self join on equal
    groups and different keys counts. Keys and groups that are null are in no pair; keys without a pair give no row."""
    own = rows.where(F.col(key).isNotNull() & F.col(group).isNotNull()).groupBy(group, key).agg(F.count("*").alias("_own"))
    whole = own.groupBy(group).agg(F.sum("_own").alias("_all"))
    pairs = own.join(whole, group).where("_all > _own")
    return pairs.groupBy(F.col(key).alias(a)).agg(F.sum(F.col("_own") * (F.col("_all") - F.col("_own"))).alias(n))
