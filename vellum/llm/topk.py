"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are integers by component ("terms"). A block of candidates keeps a posting column a term; the rows of a query
block scatter query weight x posting into dense score arrays, term by term, and skip the terms they do not
have. Each block selects its k best by partition, and the selections are merged.

Candidates are packed in blocks of rows, queries in blocks too; every query block meets every candidate block: query blocks are
staged once and dealt into slices of bounded bytes, and each partition of candidates reads each slice. No block is copied, nothing
is broadcast or collected, and no pair of vectors is ever a row.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
a missing component of a shorter vector counts as 0; rows that share the query's id are its own and no candidates;
repeated equal queries are asked once; equal candidate rows are all ranked; ties go to the smaller id; an empty
table gives no rows; scaled components and scores beyond a long are clipped to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import ship, stage

BLOCK, QUERY_BLOCK, SCORE_ROWS = 8192, 2048, 64
#: Bytes of query blocks that a task holds at once.
SLICE_BYTES = 32 << 20


def quantise(df: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, for rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _packed(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("v").combine_chunks()
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten().to_numpy()
            matrix = np.zeros((int(size.max(initial=0)), len(size)), np.int64)  # a row a term: its postings
            row = np.repeat(np.arange(len(size)), size)
            matrix[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), row] = flat
            ids = table.column("vec_id").to_numpy().astype("<i8")
            held, n = [], 0
            return pa.record_batch([pa.array([ids.tobytes()]), pa.array([matrix.tobytes()]), pa.array([matrix.shape[0]], pa.int32())], names=["ids", "matrix", "terms"])

        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(rows - n, b.num_rows - at)
                held.append(b.slice(at, take))
                n, at = n + take, at + take
                if n == rows:
                    yield flush()
        if n:
            yield flush()

    return run


def scores(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Inner products of query rows (queries x terms) with candidates (terms x candidates), a term at a time."""
    terms = min(queries.shape[1], postings.shape[0])
    most = lambda a: max((abs(int(a.max())), abs(int(a.min())))) if a.size else 0
    big = most(queries) * most(postings) * max(1, terms) >= 1 << 62
    if big:
        queries, postings = queries.astype(object), postings.astype(object)
    out = np.zeros((len(queries), postings.shape[1]), object if big else np.int64)
    for t in range(terms):
        has = np.flatnonzero(queries[:, t])
        if len(has) == len(queries):
            out += queries[:, t, None] * postings[t]
        elif len(has):
            out[has] += queries[has, t, None] * postings[t]
    return np.clip(out, -(1 << 63), (1 << 63) - 1).astype(np.int64) if big else out


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], ~score[at]))[:k]]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                postings = np.frombuffer(r["matrix"], np.int64).reshape(r["terms"], len(ids))
                queries = np.frombuffer(r["q_matrix"], np.int64).reshape(r["q_terms"], len(q_ids)).T
                found = []
                for at in range(0, len(q_ids), SCORE_ROWS):
                    part = scores(np.ascontiguousarray(queries[at : at + SCORE_ROWS]), postings)
                    for i, row in enumerate(part):
                        q = at + i
                        other = np.flatnonzero(ids != q_ids[q])
                        top = other[best(row[other], ids[other], k)]
                        found.append((np.full(len(top), q_ids[q]), np.full(len(top), q), ids[top], row[top]))
                if found:
                    qid, q, vec, score = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.record_batch([pa.array(qid), pa.array(np.full(len(q), r["q_block"])), pa.array(q), pa.array(vec), pa.array(score)], names=["query_id", "q_block", "q", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best candidates; both sides as from quantise."""
    spark = vectors.sparkSession
    ship(spark)
    packed = "ids binary, matrix binary, terms int"
    # sorted, so that a task that runs again makes the same blocks
    asked = queries.dropDuplicates(["vec_id", "v"]).sortWithinPartitions("vec_id", "v").mapInArrow(_packed(QUERY_BLOCK), packed)
    asked = asked.select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("terms").alias("q_terms"), F.xxhash64("ids", "matrix").alias("q_block"))
    asked = stage(asked, "topk")
    held = asked.agg(F.sum(F.octet_length("q_ids").cast("long") + F.octet_length("q_matrix"))).first()[0] or 0
    asked = asked.repartition(-(-held // SLICE_BYTES) or 1)
    blocks = vectors.mapInArrow(_packed(BLOCK), packed)
    blocks = blocks.repartition(F.xxhash64("ids", "matrix"))
    # the hint keeps Spark from a broadcast, which would go through the driver
    found = blocks.crossJoin(asked.hint("shuffle_replicate_nl")).mapInArrow(_search(k), "query_id long, q_block long, q long, vec_id long, score long")
    order = Window.partitionBy("query_id", "q_block", "q").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
