"""Approximate nearest neighbours by inner product, with an inverted multi-index.

Vectors are cut into two halves, each quantised with its own codebook; a vector's cell is the pair
of its two nearest centroids, so K centroids per half make K * K cells. A query orders the
centroids of each half by inner product and walks the pairs in order of their sum with a heap (the
multi-sequence walk), until the cells it has taken hold enough entries. The entries of those cells
are then ranked by their true inner products.

Codebooks are fitted on a bounded sample, and have more centroids the more entries there are; every
row is indexed. How many entries are enough is measured, unless given: a bounded number of the queries
is compared with all entries, and the share is taken that would have found so much of their true
neighbours. So vectors with structure are searched by a few cells, and vectors without any by many.
Cell sizes, K * K numbers at most, are known to the walk. Equal vectors are one entry as long as the
search runs: of them only those of smallest id can be among the nearest, so no heap of copies fills a cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.scratch import write_scratch
from pairloom.session import ship_package

SAMPLE = 20_000  # vectors that the codebooks are fitted on, at most
CELL_ENTRIES = 25  # entries of a cell, on average, that the number of centroids aims at
MOST_CENTROIDS = 256  # per half
RECALL = 0.95  # of the neighbours of the probes
PROBES = 64  # queries that are compared with all entries, at most
BLOCK = 4_096  # entries of a shard


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of ``points``, at most ``k``; the same for the same points in the same order."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    centres = points[np.random.default_rng(0).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=k)[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each point, the first of equals."""
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        cut = self.first.shape[1]
        return nearest(vectors[:, :cut], self.first) * len(self.second) + nearest(vectors[:, cut:], self.second)

    def walk(self, query: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
        """Cells by falling sum of the halves' inner products, until they hold ``enough`` entries."""
        cut, width = self.first.shape[1], len(self.second)
        a, b = self.first @ query[:cut], self.second @ query[cut:]
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, seen, taken, held = [(-(a[by_a[0]] + b[by_b[0]]), 0, 0)], {(0, 0)}, [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = int(by_a[i]) * width + int(by_b[j])
            if sizes[cell]:
                taken.append(cell)
                held += int(sizes[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(a[by_a[x]] + b[by_b[y]]), x, y))
        return taken


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, v)`` of rows that take part, v in doubles, each once: an id, no null or non-finite component, not all zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"))
        .filter("id IS NOT NULL AND v IS NOT NULL")
        .filter(finite & F.exists("v", lambda x: x != 0))
        .distinct()
    )


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column."""
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(column) else []


_FOUND = "query_id long, vec_id long, score double"


def _found(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    query = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int64)
    ids, scores = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0) for i in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids.astype(np.int64)), pa.array(scores.astype(float))], ["query_id", "vec_id", "score"])


class _Shard:
    """Entries of one shard, ready to be compared."""

    def __init__(self, rows: list[pa.RecordBatch], k: int):
        self.e = np.concatenate([_matrix(r.column("v")) for r in rows])
        self.ids = [ids for r in rows for ids in _lists(r.column("ids"))]
        self.cells, self.column = np.unique(np.concatenate([r.column("cell").to_numpy() for r in rows]), return_inverse=True)
        self.reach, self.k = 1e-9 * np.abs(self.e).max() * self.e.shape[1], k

    def rank(self, asking: pa.RecordBatch) -> pa.RecordBatch:
        """At most ``k`` entries for each query that visits some of the cells."""
        q, k, out = _matrix(asking.column("v")), self.k, []
        open_ = np.stack([np.isin(self.cells, c) for c in _lists(asking.column("cells"))])
        near = np.where(open_[:, self.column], q @ self.e.T, -np.inf)
        # One entry may be the query's own, so one more than k; those within rounding stay too.
        last = np.partition(near, -(k + 1), axis=1)[:, -(k + 1)] if near.shape[1] > k + 1 else np.full(len(q), -np.inf)
        for row, query in enumerate(asking.column("query_id").to_pylist()):
            pick = np.flatnonzero((near[row] >= last[row] - self.reach * np.abs(q[row]).max()) & (near[row] > -np.inf))
            if not len(pick):
                continue
            own = [self.ids[i][self.ids[i] != query] for i in pick]
            scores, every = np.repeat((self.e[pick] * q[row]).sum(axis=1), [len(o) for o in own]), np.concatenate(own)
            top = np.lexsort((every, -scores))[:k]
            out.append((query, every[top], scores[top]))
        return _found(out)


def _rank_shards(k: int):
    """Rows come by shard, entries (role 0) before the queries that visit it (role 1), which stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, shard = None, [], None
        for batch in batches:
            key = batch.column("shard").to_numpy() * 2 + batch.column("role").to_numpy()
            edges = [*np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist(), len(key)] if len(key) else [0]
            for begin, end in zip(edges, edges[1:]):
                part = batch.slice(begin, end - begin)
                number, role = divmod(int(key[begin]), 2)
                if number != at:
                    at, rows, shard = number, [], None
                if role == 0:
                    rows.append(part)
                elif rows:
                    shard = shard or _Shard(rows, k)
                    for some in range(0, part.num_rows, 256):
                        yield shard.rank(part.slice(some, 256))

    return run


def _shards(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each cell: cells share a shard up to BLOCK entries, larger ones get several."""
    first, parts, shard, held = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // BLOCK)), 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK:
            shard, held = shard + 1, 0
        first[cell] = shard
        held += n
        if parts[cell] > 1:
            shard, held = shard + int(parts[cell]), 0
    return first, parts


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    centroids: int | None = None,
    share: float | None = None,
    recall: float = RECALL,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its ``k`` nearest among the other rows of ``vectors``.

    Both tables have ``key`` and ``vector``. Score is the inner product in double precision; equal
    scores go to the smaller id. Rows with a null id, and vectors that are null, all zero or hold a
    null or non-finite component, take no part, nor do vectors of another length than the most
    common one. Repeated rows count once; a row is never its own neighbour, by id. With fewer than
    ``k`` other rows all are returned. ``share`` is the part of all entries that a query's cells hold at
    least; if it is not given, it is what ``recall`` takes on the probes. A share of 1 makes the search exact.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    good = usable(vectors, key, vector)
    sized = good.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if sized is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good, width = good.filter(F.size("v") == sized["width"]), sized["width"]
    # Of equal vectors the k + 1 smallest ids can be among anyone's nearest (one may be the query).
    alike = Window.partitionBy("v").orderBy("id")
    entries = good.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= k + 1)
    entries = write_scratch(entries.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    total = entries.count()
    centroids = centroids or max(1, min(MOST_CENTROIDS, round((total / CELL_ENTRIES) ** 0.5)))
    sample = np.array([r["v"] for r in entries.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toLocalIterator()], float)
    cut = max(1, width // 2)
    books = Codebooks(kmeans(sample[:, :cut], centroids), kmeans(sample[:, cut:], centroids) if width > 1 else np.zeros((1, 0)))
    shared = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], [*batch.schema.names, "cell"])

    placed = write_scratch(entries.mapInArrow(place, "v array<double>, ids array<long>, cell int"), "placed")
    sizes = np.zeros(len(books.first) * len(books.second), np.int64)
    for row in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row per cell
        sizes[row["cell"]] = row["n"]
    first, parts = _shards(sizes)
    known = spark.sparkContext.broadcast((sizes, first, parts))
    asked = usable(queries, key, vector).filter(F.size("v") == width).withColumnsRenamed({"id": "query_id", "v": "q"})
    asked = write_scratch(asked, "queries")
    if share is None:
        share = _share_for(placed, asked, books, sizes, k, recall)
    enough = max(k + 1, int(np.ceil(share * total)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and shard, with the cells to look at there."""
        sizes, first, parts = known.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                at, shard, cells = [], [], []
                for i, q in enumerate(_matrix(rows.column("q"))):
                    wanted: dict[int, list[int]] = {}
                    for cell in shared.value.walk(q, sizes, enough):
                        for part in range(parts[cell]):
                            wanted.setdefault(int(first[cell]) + part, []).append(cell)
                    at += [i] * len(wanted)
                    shard += wanted
                    cells += wanted.values()
                taken = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()), rows.column("q").take(taken), rows.column("query_id").take(taken), pa.array(cells, pa.list_(pa.int32()))],
                    ["shard", "v", "query_id", "cells"],
                )

    # Routing is work per query, so queries are dealt over all cores by their number.
    tasks = max(spark.sparkContext.defaultParallelism, -(-asked.count() // BLOCK))
    visits = asked.repartition(tasks, "query_id").mapInArrow(route, "shard long, v array<double>, query_id long, cells array<int>")
    of_cell = F.element_at(F.lit(first), F.col("cell") + 1) + F.pmod(F.xxhash64("v"), F.element_at(F.lit(parts), F.col("cell") + 1))
    none = lambda kind: F.lit(None).cast(kind)
    held = placed.select(of_cell.alias("shard"), F.lit(0).alias("role"), "v", "ids", "cell", none("long").alias("query_id"), none("array<int>").alias("cells"))
    asking = visits.select("shard", F.lit(1).alias("role"), "v", none("array<long>").alias("ids"), none("int").alias("cell"), "query_id", "cells")
    met = held.union(asking).repartition("shard").sortWithinPartitions("shard", "role")
    ranked = met.mapInArrow(_rank_shards(k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _share_for(placed: DataFrame, asked: DataFrame, books: Codebooks, sizes: np.ndarray, k: int, recall: float) -> float:
    """The least share of entries with which the walk finds this much of the probes' true neighbours."""
    probes = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBES).collect()
    if not probes:
        return 1.0
    points, names = np.array([r["q"] for r in probes], float), [r["query_id"] for r in probes]
    told = placed.sparkSession.sparkContext.broadcast((points, names))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, names = told.value
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(begin, BLOCK)
                e, cell, ids = _matrix(rows.column("v")), rows.column("cell").to_numpy(), _lists(rows.column("ids"))
                out: list[tuple] = []
                for i, query in enumerate(names):
                    scores = e @ points[i]
                    for at in np.argsort(-scores, kind="stable")[: k + 1]:
                        if len(ids[at]) > 1 or ids[at][0] != query:
                            out.append((i, float(scores[at]), int(cell[at])))
                columns = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int32())], ["probe", "score", "cell"])

    best = Window.partitionBy("probe").orderBy(F.desc("score"), "cell")
    near = placed.mapInArrow(compare, "probe int, score double, cell int").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    total, needed = int(sizes.sum()), []
    walks: dict[int, dict[int, int]] = {}
    for row in near.select("probe", "cell").collect():  # at most k rows per probe
        if row["probe"] not in walks:
            order = books.walk(points[row["probe"]], sizes, total)
            walks[row["probe"]] = dict(zip(order, np.cumsum(sizes[order]).tolist()))
        needed.append(walks[row["probe"]][row["cell"]])
    if not needed:
        return 1.0
    return sorted(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] / total


def exact(vectors: pd.DataFrame, queries: np.ndarray, k: int = 20) -> dict[int, list[int]]:
    """Neighbours by comparing with every row, for measuring recall on a few queries."""
    matrix, ids = np.stack(vectors["embedding"].to_numpy()).astype(float), vectors["vec_id"].to_numpy()
    out = {}
    for query in queries:
        scores = (matrix * matrix[ids == query][0]).sum(axis=1)
        scores[ids == query] = -np.inf
        out[int(query)] = ids[np.lexsort((ids, -scores))[:k]].tolist()
    return out
