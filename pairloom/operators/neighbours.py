"""Exact nearest neighbours by squared Euclidean distance, over all vectors or in groups.

No plan here forms query-vector pairs as rows. A task holds a bounded block of queries and a
bounded block of vectors, gets their distances from one matrix product, and emits at most
``k`` rows per query; one shuffle of those rows by query gives the result. Blocks are spread
in one of two ways:

* few queries: they are broadcast, and vectors are scanned where they lie, without a shuffle;
* many queries: both sides are cut into cells. A group larger than a block is cut into as
  many vector and query blocks as it needs, and small groups share cells, so hot groups are
  split and no cell grows with the data.

With many queries, a group with more vectors than a block is first cut into regions by splits
fitted on a sample. A query meets the region it lies in, and then only those that are no
farther than its ``k``-th neighbour there. So its work follows the regions near it and not the
group, as long as the vectors have few dimensions or lie in clusters; else regions prune
nothing, and all blocks are met. Results are exact either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import vectors as vec
from pairloom.operators.row_index import number_rows
from pairloom.scratch import write_scratch
from pairloom.session import ship_package

NEIGHBOURS = 3  # fixed value: default k
# How a missing neighbour is marked in result matrices.
MISSING_ID = -1
MISSING_DISTANCE = 3.4028234663852886e38

# Queries are broadcast up to this many, and up to this many bytes.
BROADCAST_QUERIES = 20_000
BROADCAST_BYTES = 80 << 20
# A cell holds up to this many vectors, and up to this many bytes.
BLOCK_ROWS = 16_384
BLOCK_BYTES = 64 << 20
# Up to this many groups larger than a block, their list is broadcast.
BROADCAST_GROUPS = 200_000
# Beyond that they are joined, the rows of each group in so many places.
SALTS = 16
# Regions are fitted on so many sampled vectors per block, and on up to this many bytes in all.
SAMPLE_PER_BLOCK = 64
SAMPLE_BYTES = 16 << 20
# A sampled region is not split below this many vectors of the sample.
SAMPLE_LEAST = 8

_TILE = 1024  # queries per matrix product
_GATHER = 8192  # candidates whose exact distance is computed at once
_ROUTED = 1 << 17  # components of queries that look for regions at once
_NO_ID = np.iinfo(np.int64).max  # marks a place that no vector took

_CANDIDATES = "query_id long, distance double, vec_id long"


# ---------------------------------------------------------------- small operators around it


def check_dimension(df: DataFrame, vector: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has the dimension, and the rest."""
    fits = vec.has_dimension(F.col(vector), dimension)
    return df.filter(fits), df.filter(~fits)


def require_dimension(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """The same rows; the job fails if a vector has another dimension."""
    message = F.concat(
        F.lit(f"expected a vector of dimension {dimension}, got "), F.size(vector).cast("string")
    )
    fits = vec.has_dimension(F.col(vector), dimension)
    return df.filter(F.when(fits, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def add_vectors(
    base: DataFrame,
    new: DataFrame,
    *order_by: str | Column,
    vec_id: str = "vec_id",
    unique: bool = False,
) -> DataFrame:
    """``base`` and, with ids that go on from its highest one in the given order, ``new``.

    Set ``unique`` if the order columns tell the new rows apart: vectors then need no sorting.
    """
    start = base.agg(F.coalesce(F.max(vec_id) + 1, F.lit(0)).cast("long")).first()[0]
    numbered = number_rows(new, *order_by, name=vec_id, unique=unique)
    return base.unionByName(numbered.withColumn(vec_id, F.col(vec_id) + F.lit(start)))


def result_matrix(found: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """One row per query with its distances and ids as arrays of exactly ``k``.

    Missing neighbours are marked by id -1. Given the table of ``query_id``, queries without
    any neighbour get a row as well.
    """
    rows = found.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "distance", "vec_id"))).alias("hits")
    )
    if queries is not None:
        rows = queries.select("query_id").join(rows, "query_id", "left")
    hits = F.coalesce("hits", F.array().cast("array<struct<rank:int,distance:double,vec_id:bigint>>"))
    gap = F.lit(k) - F.size(hits)
    return rows.select(
        "query_id",
        F.concat(hits["distance"], F.array_repeat(F.lit(MISSING_DISTANCE), gap)).alias("distances"),
        F.concat(hits["vec_id"], F.array_repeat(F.lit(MISSING_ID).cast("long"), gap)).alias("vec_ids"),
    )


# ---------------------------------------------------------------- search


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    group: str | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest vectors of each query: ``(query_id, rank, vec_id, distance)``.

    ``vectors`` is ``(vec_id, vector)`` and ``queries`` is ``(query_id, vector)``; with
    ``group``, both have that column and a query only meets vectors of its own group.
    Distances are squared and summed in double; ties go to the lower id. A query with fewer
    than ``k`` vectors to meet gets fewer rows. Ids and groups are whole numbers, and an id
    tells its row apart. Vectors of other element types than float are taken as doubles. A vector
    with a component that is not finite is nobody's neighbour; one whose squared length is beyond
    a double fails the job. Queries are written once, so they may come from a model.
    """
    ship_package(vectors.sparkSession)
    group_col = F.lit(0).cast("long") if group is None else F.col(group).cast("long")
    left = vectors.select(group_col.alias("grp"), F.col("vec_id").cast("long").alias("vec_id"), _floats(vectors))
    right = queries.select(group_col.alias("grp"), F.col("query_id").cast("long").alias("query_id"), _floats(queries))
    if group is not None:  # a row without a group meets nothing
        left, right = left.filter(F.col("grp").isNotNull()), right.filter(F.col("grp").isNotNull())
    right = write_scratch(right, "queries")
    n_queries, dimension = right.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    width = max(1, dimension) * (8 if "double" in right.schema["vector"].dataType.simpleString() else 4)
    block_rows = max(1, min(block_rows, BLOCK_BYTES // width))
    if n_queries <= broadcast_queries and n_queries * width <= BROADCAST_BYTES:
        candidates = _scan(left, right.toArrow(), k, grouped=group is not None)
    else:
        candidates = _many(left, right, k, block_rows, width)
    best = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return (
        candidates.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "distance")
    )


def _floats(df: DataFrame) -> Column:
    """The vector column as it is if its elements are floats or doubles, else in doubles."""
    kind = df.schema["vector"].dataType
    known = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    return F.col("vector") if known else F.col("vector").cast("array<double>").alias("vector")


def _scan(vectors: DataFrame, block: pa.Table, k: int, grouped: bool) -> DataFrame:
    """Candidates per scan task, with all queries broadcast. Vectors of groups that no query
    asks for are dropped before they reach Python."""
    held = (
        block.column("grp").to_numpy(),
        block.column("query_id").to_numpy(),
        _matrix(block.column("vector").combine_chunks()),
    )
    shared = vectors.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*shared.value, k)
        for batch in batches:
            if batch.num_rows:
                best.meet(*_columns(batch, "vec_id"))
        yield from best.emit().to_batches()

    if grouped:
        asked = pa.table({"grp": pc.unique(block.column("grp"))})  # at most one per query
        vectors = vectors.join(
            F.broadcast(vectors.sparkSession.createDataFrame(asked)), "grp", "left_semi"
        )
    return vectors.mapInArrow(run, _CANDIDATES)


def _many(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int, width: int) -> DataFrame:
    """Candidates of many queries: by regions in groups that these cut, else by cells."""
    sizes = vectors.groupBy("grp").agg(F.count("*").alias("n_v"))
    asked = queries.groupBy("grp").agg(F.count("*").alias("n_q"))
    sizes = write_scratch(sizes.join(asked, "grp").select("grp", "n_v"), "asked-sizes")
    crowded = sizes.filter(F.col("n_v") > block_rows)
    n_asked = sizes.count()
    n_crowded, rows = crowded.agg(F.count("*"), F.coalesce(F.sum("n_v"), F.lit(0))).first()
    regions = None
    if 0 < n_crowded <= BROADCAST_GROUPS:
        share = min(1.0, SAMPLE_PER_BLOCK / block_rows, SAMPLE_BYTES / (rows * width))
        regions = _fit_regions(vectors.join(F.broadcast(crowded.select("grp")), "grp", "left_semi"), share, block_rows)
    if regions is None or not len(regions.groups):
        return _cells(vectors, queries, k, block_rows)
    cut = F.broadcast(vectors.sparkSession.createDataFrame(pa.table({"grp": regions.groups})))
    near = _by_regions(vectors.join(cut, "grp", "left_semi"), queries.join(cut, "grp", "left_semi"), k, block_rows, regions)
    if len(regions.groups) == n_asked:
        return near
    rest = _cells(vectors.join(cut, "grp", "left_anti"), queries.join(cut, "grp", "left_anti"), k, block_rows)
    return rest.unionByName(near)


def _fit_regions(vectors: DataFrame, share: float, block_rows: int) -> _Regions:
    """Regions of about a block, from a share of the vectors picked by a hash of their id."""
    picked = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    groups, _, matrix = _columns(vectors.filter(picked).toArrow(), "vec_id")
    most = block_rows if share == 1 else max(SAMPLE_LEAST, int(share * block_rows))
    return _Regions(groups, matrix, most)


def _by_regions(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int, regions: _Regions) -> DataFrame:
    """Candidates from each query's own region, and from all others within reach of its ``k``-th there."""
    shared = vectors.sparkSession.sparkContext.broadcast(regions)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        groups, ids, matrix = _columns(batch, "vec_id")
        at = np.flatnonzero(_measurable(matrix))
        leaves = shared.value.leaf(groups[at], matrix[at])
        if shared.value.stuck.any():
            kept = _without_spare_copies(leaves, ids[at], matrix[at], k)
            at, leaves = at[kept], leaves[kept]
        return pa.record_batch([pa.array(leaves), batch["vec_id"].take(at), batch["vector"].take(at)], ["grp", "vec_id", "vector"])

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        groups, _, matrix = _columns(batch, "query_id")
        at = np.flatnonzero(np.isfinite(matrix).all(axis=1))  # others have no distance to anything
        leaves = shared.value.leaf(groups[at], matrix[at])
        return pa.record_batch(
            [pa.array(leaves), batch["query_id"].take(at), batch["vector"].take(at), batch["grp"].take(at)],
            ["grp", "query_id", "vector", "tree"],
        )

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        home, _, matrix = _columns(batch, "query_id")
        rows, leaves = shared.value.near(batch["tree"].to_numpy(), matrix, batch["reach"].to_numpy())
        other = leaves != home[rows]
        rows, leaves = rows[other], leaves[other]
        starts = np.searchsorted(rows, np.arange(len(home) + 1)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(starts), pa.array(leaves))
        return pa.record_batch([batch["query_id"], batch["vector"], batch["reach"], found], ["query_id", "vector", "reach", "leaves"])

    kind, asked_kind = (df.schema["vector"].dataType.simpleString() for df in (vectors, queries))
    placed = write_scratch(vectors.mapInArrow(_each(place), f"grp long, vec_id long, vector {kind}"), "regions")
    if regions.stuck.any():
        # Regions that no split cuts are copies. Only the k lowest ids of those can be near.
        stuck = F.broadcast(vectors.sparkSession.createDataFrame(pa.table({"grp": np.flatnonzero(regions.stuck)})))
        copies = W.partitionBy("grp", "vector").orderBy(F.col("vec_id").asc_nulls_last())
        first_copies = placed.join(stuck, "grp", "left_semi").withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k)
        placed = placed.join(stuck, "grp", "left_anti").unionByName(write_scratch(first_copies.drop("copy"), "first-copies"))
    at_home = write_scratch(queries.mapInArrow(_each(settle), f"grp long, query_id long, vector {asked_kind}, tree long"), "at-home")
    first = write_scratch(_cells(placed, at_home.drop("tree"), k, block_rows), "home-candidates")
    best = W.partitionBy("query_id").orderBy("distance", "vec_id")
    reach = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("distance").alias("reach"))
    # Queries of one region look together, as they reach the same few others.
    asked = at_home.join(reach, "query_id", "left").na.fill(float("inf"), "reach").hint("rebalance", "grp").sortWithinPartitions("grp")
    looked = write_scratch(asked.mapInArrow(_each(look), f"query_id long, vector {asked_kind}, reach double, leaves array<long>"), "in-reach")
    others = looked.select(F.explode("leaves").alias("grp"), "query_id", "vector", "reach")
    return first.unionByName(_cells(placed, others, k, block_rows))


def _each(step: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over batches that leaves out empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return run


def _cells(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Candidates per cell of at most about ``block_rows`` vectors and queries. Queries with a ``reach``
    take none beyond it."""
    vectors, large, salts, small_rows = _plan_groups(vectors, queries, block_rows)
    planned = [
        # Rows of a hot group meet its plan in as many places as there are salts.
        df.withColumn("salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")).join(large, ["grp", "salt"], "left").drop("salt")
        for df, row_id in ((vectors, "vec_id"), (queries, "query_id"))
    ]
    n_shared = max(1, -(-small_rows // block_rows))

    def placed(df: DataFrame, row_id: str, own: str, other: str) -> DataFrame:
        return (
            # A large group that only one side has meets nothing.
            df.filter(F.coalesce(F.col(other), F.lit(1)) > 0)
            # A large group has cells of its own; small ones share cells.
            .withColumn(
                "cell",
                F.when(F.col("is_large"), F.xxhash64("grp", F.lit("large"))).otherwise(
                    F.pmod(F.xxhash64("grp"), F.lit(n_shared))
                ),
            )
            .withColumn(own, F.pmod(F.xxhash64(row_id), F.coalesce(F.col(own), F.lit(1))).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
            .select("cell", "v_block", "q_block", "grp", row_id, "vector", *[c for c in df.columns if c == "reach"])
        )

    cell = ["cell", "v_block", "q_block"]
    left = placed(planned[0], "vec_id", "v_block", "q_block")
    right = placed(planned[1], "query_id", "q_block", "v_block")
    # Both sides may come from one table; new names tell their columns apart.
    right = right.select(*[F.col(c).alias(f"asked_{c}") for c in right.columns])
    left, right = left.groupBy(*cell), right.groupBy(*[f"asked_{c}" for c in cell])

    def run(vector_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        if not vector_rows.num_rows or not query_rows.num_rows:
            return pa.Table.from_batches([], _ARROW_CANDIDATES)
        query_rows = query_rows.rename_columns([c.removeprefix("asked_") for c in query_rows.column_names])
        reach = query_rows["reach"].to_numpy() if "reach" in query_rows.column_names else None
        best = _Best(*_columns(query_rows, "query_id"), k, reach)
        best.meet(*_columns(vector_rows, "vec_id"))
        return best.emit()

    return left.cogroup(right).applyInArrow(run, _CANDIDATES)


def _plan_groups(
    vectors: DataFrame, queries: DataFrame, block_rows: int
) -> tuple[DataFrame, DataFrame, int, int]:
    """The vectors worth placing; the groups that need more than one block, with their numbers
    of blocks, once per salt; the number of salts; and how many vectors or queries, whichever are
    more, the other groups have.

    There are at most (rows / block_rows) large groups on either side, whatever the number of
    groups. Counting combines in each task, so a hot group sends one row per task.
    """
    sizes = (
        vectors.groupBy("grp").agg(F.count("*").alias("n_v"))
        .join(queries.groupBy("grp").agg(F.count("*").alias("n_q")), "grp", "full")
        .na.fill(0, ["n_v", "n_q"])
        .withColumn("is_large", F.greatest("n_v", "n_q") > block_rows)
    )
    sizes = write_scratch(sizes, "group-sizes")
    n_large, n_asked, n_idle, v_rows, q_rows = sizes.agg(
        F.count_if("is_large"),
        F.count_if(F.col("n_q") > 0),
        F.count_if(F.col("n_q") == 0),
        F.sum(F.when(~F.col("is_large"), F.col("n_v"))),
        F.sum(F.when(~F.col("is_large"), F.col("n_q"))),
    ).first()
    large = sizes.filter("is_large").select(
        "grp",
        "is_large",
        F.ceil(F.col("n_v") / block_rows).cast("int").alias("v_block"),
        F.ceil(F.col("n_q") / block_rows).cast("int").alias("q_block"),
    )
    salts = 1 if n_large <= BROADCAST_GROUPS else SALTS
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if salts == 1:
        large = F.broadcast(large)
    if n_idle and n_asked <= BROADCAST_GROUPS:
        asked = sizes.filter(F.col("n_q") > 0).select("grp")
        vectors = vectors.join(F.broadcast(asked), "grp", "left_semi")
    return vectors, large, salts, max(v_rows or 0, q_rows or 0)


# ---------------------------------------------------------------- inside a task

_ARROW_CANDIDATES = pa.schema(
    [("query_id", pa.int64()), ("distance", pa.float64()), ("vec_id", pa.int64())]
)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    if len(lists) == 0:
        return np.zeros((0, 0), np.float32)
    lengths = pc.min_max(lists.value_lengths()).as_py()
    flat = lists.flatten()
    if lists.null_count or flat.null_count or lengths["min"] != lengths["max"]:
        raise ValueError("vectors must have one dimension and no nulls; see check_dimension")
    flat = flat.to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _columns(rows: pa.Table | pa.RecordBatch, row_id: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vector = rows.column("vector")
    if isinstance(vector, pa.ChunkedArray):
        vector = vector.combine_chunks()
    return rows.column("grp").to_numpy(), rows.column(row_id).to_numpy(), _matrix(vector)


def _without_spare_copies(groups: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> np.ndarray:
    """Row numbers in group order, without the copies of a vector beyond the ``k`` with the
    lowest ids of its group: those are never among the ``k`` nearest of any query. So a large
    set of copies costs no more than ``k`` vectors."""
    if not len(ids):
        return np.arange(0)
    bits = np.ascontiguousarray(matrix).view(np.uint32).reshape(len(matrix), -1)
    weights = np.random.default_rng(0).integers(1, 2**63, bits.shape[1], dtype=np.uint64)
    digest = np.zeros(len(matrix), np.uint64)
    for s in range(0, len(bits), _GATHER):  # sums wrap around, so equal rows have equal digests
        digest[s : s + _GATHER] = (bits[s : s + _GATHER] * weights).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((ids, digest, groups))
    new = np.append(
        True, (np.diff(groups[order]) != 0) | (digest[order][1:] != digest[order][:-1])
    )
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(order)))
    keep = np.ones(len(order), bool)
    for start, length in zip(starts[lengths > k], lengths[lengths > k]):
        run = order[start : start + length]
        if (bits[run] == bits[run[0]]).all():  # else two vectors share a digest: keep all
            keep[start + k : start + length] = False
    return order[keep]


def _measurable(matrix: np.ndarray) -> np.ndarray:
    """Which vectors are finite; one that is too long for a distance fails the job."""
    finite = np.isfinite(matrix).all(axis=1)
    if not np.isfinite(np.einsum("ij,ij->i", matrix[finite], matrix[finite], dtype=np.float64)).all():
        raise ValueError("a vector is too long for its squared length to be a number")
    return finite


class _Regions:
    """Each group's space cut by splits at medians of a sample, down to leaves of ``most`` sampled
    vectors. Leaves are numbered over all groups; one of more vectors is ``stuck``, as they are equal.
    Groups of a single leaf that is not stuck are left out."""

    def __init__(self, groups: np.ndarray, matrix: np.ndarray, most: int):
        finite = np.isfinite(matrix).all(axis=1)
        order = np.flatnonzero(finite)[np.argsort(groups[finite], kind="stable")]
        groups, matrix = groups[order], matrix[order]
        present, starts = np.unique(groups, return_index=True)
        self.dimension = matrix.shape[1]
        axis, at, child, roots, kept, stuck = [], [], [], [], [], []
        for group, start, end in zip(present, starts, np.append(starts[1:], len(groups))):
            if end - start <= most:
                continue
            kept.append(group)
            roots.append(len(axis))
            axis.append(-1), at.append(0.0), child.append(-1)
            todo = [(roots[-1], matrix[start:end])]
            while todo:
                node, part = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                widest = int(np.argmax(high.astype(np.float64) / 2 - low.astype(np.float64) / 2)) if self.dimension else 0
                if len(part) <= most or (low == high).all():
                    child[node] = len(stuck)
                    stuck.append(len(part) > most)
                    continue
                values = part[:, widest]
                middle = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
                if middle == high[widest]:
                    middle = values[values < middle].max()
                axis[node], at[node], child[node] = widest, float(middle), len(axis)
                for side in (values <= middle, values > middle):
                    todo.append((len(axis), part[side]))
                    axis.append(-1), at.append(0.0), child.append(-1)
        self.groups, self.stuck = np.array(kept, np.int64), np.array(stuck, bool)
        self._roots, self._axis, self._at, self._child = np.array(roots, int), np.array(axis, int), np.array(at), np.array(child, np.int64)

    def _start(self, groups: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        if len(groups) and matrix.shape[1] != self.dimension:
            raise ValueError(f"vectors of dimension {self.dimension} and {matrix.shape[1]} in one table; see check_dimension")
        return self._roots[np.searchsorted(self.groups, groups)]

    def leaf(self, groups: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = self._start(groups, matrix)
        inner = np.flatnonzero(self._axis[node] >= 0)
        while len(inner):
            here = node[inner]
            beyond = matrix[inner, self._axis[here]] > self._at[here]
            node[inner] = self._child[here] + beyond
            inner = inner[self._axis[node[inner]] >= 0]
        return self._child[node]

    def near(self, groups: np.ndarray, matrix: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers, in order, and leaves that may hold a vector within the row's ``reach``."""
        root = self._start(groups, matrix)
        # Bounds are rounded otherwise than distances.
        reach = reach * (1 + 1e-9) + 1e-300
        step = max(1, _ROUTED // max(1, self.dimension))
        rows_found, leaves_found = [np.zeros(0, int)], [np.zeros(0, np.int64)]
        for tree in np.unique(root):
            members = np.flatnonzero(root == tree)
            todo = [(tree, rows, np.zeros((len(rows), self.dimension))) for rows in np.split(members, range(step, len(members), step))]
            while todo:
                node, rows, gaps = todo.pop()
                axis = self._axis[node]
                if axis < 0:
                    rows_found.append(rows)
                    leaves_found.append(np.full(len(rows), self._child[node]))
                    continue
                past = matrix[rows, axis].astype(np.float64) - self._at[node]
                for side, gap in enumerate((past, -past)):
                    wider = gaps.copy()
                    wider[:, axis] = np.maximum(wider[:, axis], gap)
                    within = np.einsum("ij,ij->i", wider, wider) <= reach[rows]
                    if within.any():
                        todo.append((self._child[node] + side, rows[within], wider[within]))
        rows, leaves = np.concatenate(rows_found), np.concatenate(leaves_found)
        order = np.argsort(rows, kind="stable")
        return rows[order], leaves[order]


class _Best:
    """The ``k`` best vectors met so far by each query of a block, none beyond its ``reach``."""

    def __init__(self, groups: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, reach: np.ndarray | None = None):
        order = np.argsort(groups, kind="stable")
        self.groups, self.ids, self.matrix, self.k = groups[order], ids[order], matrix[order], k
        self.distance = np.full((len(ids), k), np.inf)
        self.vec_id = np.full((len(ids), k), _NO_ID)
        self.bounded = reach is not None
        if self.bounded:  # places are taken at that distance, after any id
            self.distance[:] = reach[order][:, None]

    def meet(self, groups: np.ndarray, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Let each query see the vectors of its group."""
        if len(self.ids) and self.matrix.shape[1] != matrix.shape[1]:
            raise ValueError(f"queries have dimension {self.matrix.shape[1]}, vectors {matrix.shape[1]}")
        # A vector with a component that is not finite has no distance to anything.
        finite = _measurable(matrix)
        groups, ids, matrix = groups[finite], ids[finite], matrix[finite]
        order = _without_spare_copies(groups, ids, matrix, self.k)
        groups, ids, matrix = groups[order], ids[order], matrix[order]
        present, starts = np.unique(groups, return_index=True)
        ends = np.append(starts[1:], len(groups))
        q_starts = np.searchsorted(self.groups, present, "left")
        q_ends = np.searchsorted(self.groups, present, "right")
        for v0, v1, q0, q1 in zip(starts, ends, q_starts, q_ends):
            for q in range(q0, q1, _TILE):
                for v in range(v0, v1, _TILE * 8):
                    w = min(v + _TILE * 8, v1)
                    self._tile(slice(q, min(q + _TILE, q1)), ids[v:w], matrix[v:w])

    def _tile(self, rows: slice, ids: np.ndarray, matrix: np.ndarray) -> None:
        """A rounded matrix product picks candidates with a margin for its error; those get
        their distance term by term, so equal vectors tie exactly."""
        queries = self.matrix[rows]
        q_norm = np.einsum("ij,ij->i", queries, queries, dtype=np.float64)
        v_norm = np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64)
        # Outside these bounds products of float32 overflow, or lose digits to underflow.
        kind = queries.dtype if 1e-20 < max(q_norm.max(), v_norm.max()) < 1e30 else np.float64
        rough = (-2 * queries.astype(kind, copy=False)) @ matrix.astype(kind, copy=False).T
        rough = rough + v_norm.astype(kind)
        rough += q_norm.astype(kind)[:, None]
        margin = (matrix.shape[1] + 16) * np.finfo(kind).eps * (q_norm + v_norm.max())
        limit = self.distance[rows, -1]
        if len(ids) > self.k:
            kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
            limit = np.minimum(limit, kth + 2 * margin)
        q_at, v_at = np.nonzero(rough <= (limit + 2 * margin)[:, None])
        if not len(q_at):
            return
        exact = np.empty(len(q_at))
        for s in range(0, len(q_at), _GATHER):
            part = slice(s, s + _GATHER)
            gap = queries[q_at[part]].astype(np.float64) - matrix[v_at[part]].astype(np.float64)
            exact[part] = (gap * gap).sum(axis=1)
        # Merge with what is held: order by (query, distance, id) and keep the first k of each.
        n = len(queries)
        all_q = np.concatenate([np.repeat(np.arange(n), self.k), q_at])
        all_d = np.concatenate([self.distance[rows].ravel(), exact])
        all_v = np.concatenate([self.vec_id[rows].ravel(), ids[v_at]])
        order = np.lexsort((all_v, all_d, all_q))
        first = np.searchsorted(all_q[order], np.arange(n))
        keep = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.distance[rows] = all_d[keep].reshape(n, self.k)
        self.vec_id[rows] = all_v[keep].reshape(n, self.k)

    def emit(self) -> pa.Table:
        """The held rows; places that no vector took are left out."""
        found = np.isfinite(self.distance).ravel()
        if self.bounded:
            found &= (self.vec_id != _NO_ID).ravel()
        return pa.Table.from_arrays(
            [
                pa.array(np.repeat(self.ids, self.k)[found]),
                pa.array(self.distance.ravel()[found]),
                pa.array(self.vec_id.ravel()[found]),
            ],
            schema=_ARROW_CANDIDATES,
        )
