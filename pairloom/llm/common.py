"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import spread

BATCH_ROWS = 1_000
_ROWS_SETTING, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
BATCH_CHARS = 1 << 19  # texts are worked on in chunks of about this many characters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Only the columns an operator works on, in enough tasks for costly work.

    Rows of texts are wide, so Arrow batches are held to ``BATCH_ROWS``, unless the session has a
    number of its own.
    """
    conf = df.sparkSession.conf
    if conf.get(_ROWS_SETTING) == _ROWS_DEFAULT:
        conf.set(_ROWS_SETTING, str(BATCH_ROWS))
    return spread(df.select(*columns))


def fold(key: Column | str, folds: int) -> Column:
    """Remainder of the CRC of a key's decimal form; null keys count as the empty text."""
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))) % folds


def chunks(batch: pa.RecordBatch, column: str, most: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Row slices of a batch with their texts (null: empty), each of about ``most`` characters.

    A text longer than that is a chunk of its own; no text is cut.
    """
    values = batch.column(column)
    begin, size, kept = 0, 0, []
    for i in range(batch.num_rows):
        text = values[i].as_py() or ""
        if kept and size + len(text) > most:
            yield batch.slice(begin, i - begin), kept
            begin, size, kept = i, 0, []
        kept.append(text)
        size += len(text)
    if kept:
        yield batch.slice(begin), kept
