"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.scratch import write_scratch
from pairloom.session import ship_package

PART_EDGES = 250_000  # edges that a task joins up at a time, about
MAX_ROUNDS = 60  # rounds grow with the logarithm of a component's length; this is only a guard


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame) -> DataFrame:
    """One round of star contraction.

    Every node first links its larger neighbours to the smallest node it knows, then its smaller
    neighbours. Components stay the same, and each ends as one star around its smallest node.
    """
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    return (
        small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
    ).distinct()


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as stars around the smallest node of each of their components, ``PART_EDGES`` at a time:
    fewer edges than nodes, whatever a task's share is."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, y) for x in list(above) if (y := top(x)) != x]
        above.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    taken = 0
    for batch in batches:
        if taken and taken + batch.num_rows > PART_EDGES:
            yield stars()
            taken = 0
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
        taken += batch.num_rows
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (long columns a, b); root: the component's smallest node.

    Loops and repeated edges do no harm; nodes without an edge are not listed. First each task joins
    up a bounded share of the edges, so that a dense group goes on with few of them. Each round is
    written, which cuts the lineage; nothing but a row count and a checksum reaches the driver.
    Rounds join on node numbers; a hub's rows are split by adaptive skew handling.
    """
    spark = edges.sparkSession
    ship_package(spark)
    given = write_scratch(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    tasks = max(spark.sparkContext.defaultParallelism, -(-given.count() // PART_EDGES))
    current = write_scratch(given.coalesce(tasks).mapInArrow(_joined_up, "a long, b long"), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = current.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))
        ).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        current = write_scratch(_stars(current), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select("b", "b").distinct())
