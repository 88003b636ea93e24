"""Connected components over an edge table, as rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import hot_rows, join_counted, stored

#: Edges of a task of a round.
TASK_EDGES = 100_000


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _least(edges: DataFrame, few: int) -> DataFrame:
    """a, m (the least b) and members of each a; as a table, unless it is read where it is made, in one task."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("members")).coalesce(few)
    return low if few == 1 else stored(low)


def _met(edges: DataFrame, low: DataFrame, total: int, few: int) -> DataFrame:
    """edges with the m of their a. Only where several tasks meet, and there are hubs, is anything broadcast: each broadcast
    takes memory of the driver until it is collected, however small it is, and the rounds are many."""
    if few > 1 and (low.agg(F.max("members")).first()[0] or 0) > hot_rows(total):
        return join_counted(edges, low, ["a"], total=total)
    return edges.join(low.drop("members").hint("merge"), "a")


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, root) for each node of edges (a, b) that is not its component's smallest node, the root.

    Each round is two aggregations and two joins; the edges never leave the executors, a hub's
    neighbours are never gathered, and its edges stay where they are when they meet it. Self-loops and repeats are dropped; no edges give no rows.
    Edges that still change after `most` rounds are an error. A round's tables have as few partitions as TASK_EDGES allows, since
    few edges over many tasks would be mostly files. Each half of a round is a table, so that no plan holds the other half several times.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stamp = _stamp(edges)
    for _ in range(most):
        if not stamp[0]:
            break
        few, total = 2 * stamp[0] // TASK_EDGES + 1, 2 * stamp[0]
        edges = edges.coalesce(few)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(few)
        low = _least(both, few)
        large = _met(both, low.withColumn("m", F.least("a", "m")), total, few).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a != b").coalesce(few).distinct().coalesce(few)).coalesce(few)
        low = _least(large, few)
        small = _met(large, low, total, few).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a != b").coalesce(few).distinct().coalesce(few))
        before, stamp = stamp, _stamp(edges.coalesce(few))
        if stamp == before:
            break
    else:
        raise RuntimeError(f"components: the edges still change after {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
