"""Fixed-size sequential batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import arrays as ar
from pairloom.operators.row_index import first_rows, number_rows

BATCH_SIZE = 50  # fixed value: default rows per batch


def with_batches(numbered: DataFrame, row_idx: str = "row_idx", size: int = BATCH_SIZE) -> DataFrame:
    """Add ``batch_id`` and ``pos_in_batch`` to numbered rows; the last batch may be short."""
    return numbered.withColumns(
        {
            "batch_id": F.expr(f"`{row_idx}` div {size}"),  # whole numbers, whatever the size
            "pos_in_batch": (F.col(row_idx) % size).cast("int"),
        }
    )


def assign_batches(
    df: DataFrame, *order_by: str | Column, size: int = BATCH_SIZE, unique: bool = False
) -> DataFrame:
    """Number the rows in the given order and cut them into batches."""
    return with_batches(number_rows(df, *order_by, unique=unique), size=size)


def collate(batched: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per batch, each column as a list in batch order. A batch has a fixed size, so
    no group grows with the data."""
    entry = F.struct("pos_in_batch", *columns)
    gathered = batched.groupBy("batch_id").agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    return gathered.select("batch_id", *[F.col("rows")[name].alias(name) for name in columns])


def first_batch(df: DataFrame, *order_by: str | Column, size: int = BATCH_SIZE) -> DataFrame:
    """The rows of batch 0 without numbering the table."""
    return first_rows(df, size, *order_by)


def batch_shapes(batched: DataFrame, ids: str) -> DataFrame:
    """Rows and longest id list of each batch."""
    return batched.groupBy("batch_id").agg(
        F.count("*").alias("n_rows"), F.max(F.size(ids)).alias("longest")
    )


def pad_batches(batched: DataFrame, pads: dict[str, int]) -> DataFrame:
    """Pad id columns to the longest in the batch, and add their attention masks.

    ``pads`` maps an id column to its pad id. Column ``x`` yields ``x_padded`` and
    ``x_attention``. All columns share one shuffle by batch.
    """
    batch = W.partitionBy("batch_id")
    lengths = batched.withColumns({f"__len_{c}": F.max(F.size(c)).over(batch) for c in pads})
    out = {}
    for name, pad_id in pads.items():
        length = F.col(f"__len_{name}")
        out[f"{name}_padded"] = ar.pad_to(F.col(name), length, pad_id)
        out[f"{name}_attention"] = ar.attention_mask(F.col(name), length)
    return lengths.withColumns(out).drop(*[f"__len_{c}" for c in pads])


def gather_positions(df: DataFrame, key: str | Sequence[str], pos: str, value: str) -> DataFrame:
    """One array per key with the values in position order.

    A key's rows must be the positions of one sequence: what comes out is a single row. Whole numbers are
    gathered as ``pos >> 7`` and the last seven bits: lists that repeat themselves, which compress to
    nearly nothing in the shuffle, where a list of rising numbers does not.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.col(pos)]
    if isinstance(df.select(pos).schema[0].dataType, T.IntegralType):
        order = [F.shiftright(pos, 7), F.col(pos).bitwiseAND(127).cast("byte")]  # sorts as pos does, below 0 too
    return df.groupBy(*keys).agg(ar.in_order(order, F.col(value)).alias(value))


def first_per_group(df: DataFrame, key: str | Sequence[str], order: Column, *values: str) -> DataFrame:
    """The values of the row that comes first in each group. Tasks combine before the shuffle,
    so a hot group sends one row per task."""
    keys = [key] if isinstance(key, str) else list(key)
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*values), order).alias("__first"))
        .select(*keys, *[F.col("__first")[v].alias(v) for v in values])
    )


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows, as a table of one row."""
    return df.agg(F.count("*").alias("n_rows"))
