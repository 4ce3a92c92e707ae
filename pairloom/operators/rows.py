"""Row-local operators: routing, required values, column whitelists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text as tx

# The columns a batch table may carry.
TEXT_BATCH_COLUMNS = ("inputs", "inputs_raw")
PAIR_BATCH_COLUMNS = TEXT_BATCH_COLUMNS + (
    "inputs_tokenized",
    "labels",
    "labels_raw",
    "labels_tokenized",
    "encoder_last_hidden_state",
    "token_hidden_states",
)


def with_quality(df: DataFrame, text: str, name: str = "quality_ok", **gate) -> DataFrame:
    """All rows, with the gate's verdict on one text column."""
    return df.withColumn(name, tx.quality_ok(F.col(text), **gate))


def with_reject_reason(
    df: DataFrame, source: str, target: str | None = None, name: str = "reject_reason", **gate
) -> DataFrame:
    """All rows, with the reason for rejection; null means kept."""
    other = None if target is None else F.col(target)
    return df.withColumn(name, tx.reject_reason(F.col(source), other, **gate))


def quality_filter(df: DataFrame, source: str, target: str | None = None, **gate) -> DataFrame:
    """Only the rows that are kept."""
    return df.filter(tx.reject_reason(F.col(source), None if target is None else F.col(target), **gate).isNull())


def rejected_rows(df: DataFrame, source: str, target: str | None = None, **gate) -> DataFrame:
    """Only the rows that are not kept, each with its reason."""
    return with_reject_reason(df, source, target, **gate).filter(F.col("reject_reason").isNotNull())


def count_outcomes(df: DataFrame, source: str, target: str | None = None, **gate) -> DataFrame:
    """Rows per outcome, ``ok`` or a reject reason."""
    other = None if target is None else F.col(target)
    outcome = F.coalesce(tx.reject_reason(F.col(source), other, **gate), F.lit("ok"))
    return df.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def whitelist(df: DataFrame, supported: Sequence[str]) -> DataFrame:
    """The supported columns that exist, in the order of the list; others are dropped."""
    return df.select(*[name for name in supported if name in df.columns])


def first_missing(columns: Sequence[str], accept_blank: bool = False) -> Column:
    """Name of the first listed column without a value, or null. A blank string counts as
    missing unless accepted."""

    def missing(name: str) -> Column:
        absent = F.col(name).isNull()
        return absent if accept_blank else absent | (F.col(name).cast("string") == "")

    return F.coalesce(*[F.when(missing(name), F.lit(name)) for name in columns])


def require_values(df: DataFrame, columns: Sequence[str], accept_blank: bool = False) -> DataFrame:
    """The same rows; the job fails if one lacks a value, naming the first such column.

    The check is a filter, so that pruning columns downstream cannot remove it.
    """
    name = first_missing(columns, accept_blank)
    message = F.concat(F.lit("Missing required value '"), name, F.lit("'"))
    return df.filter(F.when(name.isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def attach(df: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` with the other columns of ``extra``, which has one row per key. Null
    keys meet null keys, so no row is lost."""
    other = extra.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    return df.join(other, same, "left").drop(*[f"__key_{k}" for k in keys])
