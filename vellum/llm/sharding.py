"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix. DataFrame functions only.

1. The rows are written once to the shared folder with the number of their partition and, after a local permutation
   (sort within the partition by a random key), their rank in it.
2. How many rows each partition sends to each shard is drawn exactly: the row of a partition is a multivariate
   hypergeometric draw from the room that is left in the shards. The matrix has a row a partition, not a row a document.
3. A row's rank and its partition's row of the matrix say its shard.
4. The rows are exchanged by (shard, bucket of a second random key) and sorted there by that key: a second uniform
   permutation. A bucket's first slot is the number of rows in the shard's buckets before it, so no task holds a shard.

Defined cases: nulls in any column are kept as they are; equal rows are separate rows; an empty table stays empty;
columns of any name are carried along (those named shard or slot are replaced).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import size_in_bytes, stage

#: Partitions up to which the matrix (a few longs a partition) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_PARTITIONS = 50_000
#: Bytes of the staged rows that one task of the exchange sorts; buckets whose sizes are broadcast (three numbers each).
PARTITION_BYTES, BROADCAST_BUCKETS = 64 << 20, 1_000_000


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw: how many of n rows fall in good of good + bad places.

    numpy's own draw ends at 1e9 places; beyond, the probabilities within 40 deviations of the mean are summed up.
    """
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    total = good + bad
    mean, low, high = n * (good / total), max(0, n - bad), min(good, n)
    wide = int(40 * (mean * (bad / total)) ** 0.5) + 40
    low, high = max(low, int(mean) - wide), min(high, int(mean) + wide)
    k = np.arange(low, high, dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1)))])
    weight = np.cumsum(np.exp(log - log.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def draw_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from each partition to each shard; rows sum to counts, columns to sizes at most one apart."""
    rng, total = np.random.default_rng(seed), int(sum(counts))
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        left, rest = int(n), int(room.sum())
        for s in range(shards):
            rest -= int(room[s])
            if left and room[s]:
                out[i, s] = draw(rng, int(room[s]), rest, left)
            left -= int(out[i, s])
        room -= out[i]
    return out


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 17, buckets: int | None = None) -> DataFrame:
    """df's columns with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard)."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    columns = df.columns
    body = F.struct(*[df[f"`{c}`"] for c in columns]).alias("_row")
    local = df.select(body, F.spark_partition_id().alias("_part"), F.rand(seed).alias("_key")).sortWithinPartitions("_key")
    ranked = local.select("_row", "_part", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_rank"))
    held = stage(ranked, "shuffle")

    counts = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count("*").alias("n")).collect())
    matrix = np.cumsum(draw_matrix([n for _, n in counts], shards, seed), axis=1)
    rows = [(p, [int(x) for x in matrix[i]]) for i, (p, _) in enumerate(counts)]
    limits = spark.createDataFrame(rows, "_part int, _limits array<bigint>")
    limits = F.broadcast(limits) if len(rows) <= BROADCAST_PARTITIONS else limits
    key = F.xxhash64(F.lit(seed), F.col("_part"), F.col("_rank"))
    total = sum(n for _, n in counts)
    # buckets of some MB, whatever the size of the table, in as many partitions as that takes
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size_in_bytes(held) // PARTITION_BYTES)
    buckets = buckets or max(1, min(-(-4 * parts // shards), total // 64))
    sent = held.join(limits, "_part").select(
        "_row",
        F.size(F.filter("_limits", lambda x: x <= F.col("_rank"))).alias("shard"),
        key.alias("_key"),
        F.struct("_part", "_rank").alias("_tie"),
    ).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_key", 20), F.lit(buckets)).cast("int"))

    sizes = sent.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))  # shards x buckets rows
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    bases = F.broadcast(bases) if shards * buckets <= BROADCAST_BUCKETS else bases
    inside = Window.partitionBy("shard", "_bucket").orderBy("_key", "_tie")
    placed = sent.repartition(parts, "shard", "_bucket").withColumn("_slot", F.row_number().over(inside)).join(bases, ["shard", "_bucket"])
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in columns], "shard", (F.col("_base") + F.col("_slot") - 1).alias("slot"))
