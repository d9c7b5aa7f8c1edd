"""Connected components of an edge list, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over edges; rounds are cut by tables in the shared folder, and nothing but
counts reaches the driver. The edges shrink to stars in a logarithmic number of rounds in practice. The edges of a hub
(a node with more edges than a partition's share) are not brought together: what they are joined with is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import join_split, stage

#: Edges that one task may hold of one node; edges that are worth a task.
LIMIT, TASK_EDGES = 200, 2000


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour and number of neighbours of each a; counted up in each task first."""
    return stage(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")


def _star(edges: DataFrame, count: int) -> DataFrame:
    """Points each neighbour above a node, and the node itself, at the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "m").alias("m"), "n")
    met = join_split(both, least, ["a"], "n", 2 * count, least=LIMIT)
    return met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame, count: int) -> DataFrame:
    """Edges have a > b; the smaller neighbours of a, and a, point at the least of them."""
    least = _least(edges)
    moved = join_split(edges, least, ["a"], "n", count, least=LIMIT).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _packed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Staged edges in no more partitions than they need, and their number."""
    held = stage(edges, "edges")
    n = held.count()
    return held.coalesce(max(1, -(-n // TASK_EDGES))), n


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node that has an edge a - b; loops and repeated edges do not matter."""
    now, n = _packed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        # a star forest: every a has one b, and no b is an a
        loose = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        chained = 0 if loose else now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not loose and not chained:
            break
        now, n = _packed(_star(now, n))
        now, n = _packed(_small(now, n))
    both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))
    return now.select(F.explode(both).alias("x")).select("x.node", "x.component").distinct()
