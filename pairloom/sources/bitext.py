"""Readers and writers for parallel text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.row_index import RowIndex, index_rows

# The texts that count as missing by default when delimited text is read.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# Where a row stands in its files, as an order: file, split of the file, place in the task's read.
POSITION = ("file_path", "block_start", "place")


def _position() -> list:
    return [
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("place"),
    ]


def numbered(rows: DataFrame, name: str = "row_idx") -> RowIndex:
    """Rows read with their position, numbered from 0 in the order of their files; see ``RowIndex``."""
    return index_rows(rows, *POSITION, name=name, unique=True)


def _csv_reader(spark: SparkSession, multiline: bool):
    return (
        spark.read.option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        # A file whose header differs from the first one's fails instead of being misread.
        .option("enforceSchema", False)
    )


def read_bitext(
    spark: SparkSession,
    path: str | list[str],
    source: str = "english",
    target: str = "german",
    header: bool = True,
    multiline: bool = True,
    na_tokens: Sequence[str] | None = None,
    position: bool = False,
) -> DataFrame:
    """Two string columns of a CSV, found by name in the header.

    All columns are strings, so there is no inference pass; only the header line is looked at.
    Without a header the first two fields are taken. ``multiline`` allows line breaks inside
    quoted fields, at the price of one task per file; switch it off for data without them.
    ``position`` adds the columns ``POSITION``, which give the order of files and of rows in them.
    """
    where = _position() if position else []
    reader = _csv_reader(spark, multiline)
    if header:
        df = reader.option("header", True).csv(path).select(source, target, *where)
    else:
        schema = T.StructType([T.StructField(source, T.StringType()), T.StructField(target, T.StringType())])
        df = reader.option("header", False).schema(schema).csv(path).select(source, target, *where)
    return nullify_tokens(df, [source, target], na_tokens) if na_tokens is not None else df


def read_text_column(
    spark: SparkSession,
    path: str | list[str],
    column: str,
    multiline: bool = True,
    na_tokens: Sequence[str] | None = None,
    position: bool = False,
) -> DataFrame:
    """One string column of a CSV with header. An unknown name fails the analysis."""
    where = _position() if position else []
    df = _csv_reader(spark, multiline).option("header", True).csv(path).select(column, *where)
    return nullify_tokens(df, [column], na_tokens) if na_tokens is not None else df


def nullify_tokens(
    df: DataFrame, columns: Iterable[str], tokens: Sequence[str] = NA_TOKENS
) -> DataFrame:
    """Turn the listed texts into nulls in the given columns."""
    return df.withColumns(
        {name: F.when(~F.col(name).isin(*tokens), F.col(name)) for name in columns}
    )


def inline_pairs(
    spark: SparkSession,
    sources: Sequence[str | None],
    targets: Sequence[str | None],
    source: str = "source",
    target: str = "target",
) -> DataFrame:
    """Pairs from two parallel lists in the program."""
    if len(sources) != len(targets):
        raise ValueError(f"{len(sources)} sources but {len(targets)} targets")
    return spark.createDataFrame(list(zip(sources, targets)), f"{source} string, {target} string")


def csv_writer(df: DataFrame, header: bool = True, mode: str = "overwrite"):
    """Writer for fully quoted CSV that keeps blanks, quotes and line breaks as they are."""
    return (
        df.write.mode(mode)
        .option("header", header)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_bitext(
    df: DataFrame,
    path: str,
    columns: Sequence[str] | None = None,
    header: bool = True,
    mode: str = "overwrite",
) -> None:
    """Write the columns, in this order, as fully quoted CSV."""
    csv_writer(df.select(*columns) if columns else df, header, mode).csv(path)
