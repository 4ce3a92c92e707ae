"""The retrieval job: normalise vectors, then search them exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.vectors import l2_normalize
from pairloom.operators.neighbours import NEIGHBOURS, require_dimension, search
from pairloom.operators.row_index import first_rows
from pairloom.sources.growing_store import GrowingStore
from pairloom.sources.vector_tables import read_buckets_of


def normalized(df: DataFrame, vector: str = "vector") -> DataFrame:
    """The table with its vectors scaled to length 1."""
    return df.withColumn(vector, l2_normalize(F.col(vector)))


def search_table(
    vectors: DataFrame,
    dimension: int,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    group: str | None = None,
    **limits,
) -> DataFrame:
    """Search ``(vec_id, vector)`` after scaling; a vector of another dimension fails the job."""
    index, asked = (normalized(require_dimension(df, "vector", dimension)) for df in (vectors, queries))
    return search(index, asked, k, group, **limits)


def search_all(vectors: DataFrame, dimension: int, k: int = NEIGHBOURS, group: str | None = None, **limits) -> DataFrame:
    """Search a table with each of its vectors, which finds itself first.

    Without groups this compares all with all: work grows with the square of the table. With
    groups it grows with the squares of their sizes.
    """
    return search_table(vectors, dimension, vectors.withColumnRenamed("vec_id", "query_id"), k, group, **limits)


def search_first(vectors: DataFrame, n: int, k: int = NEIGHBOURS) -> DataFrame:
    """Search a table with its own first ``n`` vectors as queries."""
    index = normalized(vectors)
    queries = first_rows(vectors, n, "vec_id").withColumnRenamed("vec_id", "query_id")
    return search(index, normalized(queries), k)


def search_store(
    path: str,
    queries: DataFrame,
    group: str,
    k: int = NEIGHBOURS,
    vector: str = "vector",
    **limits,
) -> DataFrame:
    """Search a store written by group: only the buckets of the queries' groups are read.

    The store has ``vec_id``, the group and the vector column; ``queries`` has ``query_id``, the
    group and ``vector``. Vectors are taken as they are on both sides.
    """
    # The search itself drops vectors of groups that no query asks for.
    stored = read_buckets_of(queries.sparkSession, path, group, queries)
    return search(stored.withColumnRenamed(vector, "vector"), queries, k, group, **limits)


def search_growing(store: GrowingStore, queries: DataFrame, k: int = NEIGHBOURS, vector: str = "vector", **limits) -> DataFrame:
    """Search one version of a growing store within groups; only files that hold a group of the queries
    are opened. ``queries`` has ``query_id``, the store's group and ``vector``."""
    stored = store.rows_of(queries).withColumnsRenamed({vector: "vector", store.vec_id: "vec_id"})
    return search(stored, queries, k, store.group, **limits)
