"""Costly work that goes on where it stopped: a ledger of finished parts next to the output.

Rows are dealt over parts by a hash of their key. A few parts at a time are worked on and written, and
then entered in the ledger. A part is in the ledger if and only if its output is whole, so a run
after a failure works on the other parts only, and writes over what was left of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.scratch import write_scratch
from pairloom.sources.files import Taken, commit_json, list_names, read_json

PART = "part"


def finished_parts(df: DataFrame, path: str) -> set[int]:
    return {int(n.removesuffix(".json")) for n in list_names(df.sparkSession, f"{path}/ledger") if n.removesuffix(".json").isdigit()}


def run_parts(
    df: DataFrame, key: str | Sequence[str], work: Callable[[DataFrame], DataFrame], path: str, n_parts: int = 64, at_a_time: int = 8
) -> DataFrame:
    """``work`` of all rows of ``df``, written to ``path`` part by part, and read back.

    ``work`` maps rows to rows, each on its own, and keeps the key. Rows go to ``work`` once over all runs with
    this ``path``, but for those of parts that were under way when a run broke. The first run fixes the
    number of parts; another number fails. A row with a null in its key has a part like any other.
    """
    keys, spark, path = [key] if isinstance(key, str) else list(key), df.sparkSession, path.rstrip("/")
    try:
        commit_json(spark, f"{path}/parts.json", {"n_parts": n_parts, "key": keys})
    except Taken:
        known = read_json(spark, f"{path}/parts.json")
        if known != {"n_parts": n_parts, "key": keys}:
            raise ValueError(f"{path} was begun with {known}") from None
    open_parts = sorted(set(range(n_parts)) - finished_parts(df, path))
    if open_parts:
        # Written by part once, so that each step reads its own parts only.
        dealt = df.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(n_parts)).cast("int")).filter(F.col(PART).isin(open_parts))
        dealt = write_scratch(dealt, "open-parts")
        for begin in range(0, len(open_parts), at_a_time):
            chosen = open_parts[begin : begin + at_a_time]
            rows = work(dealt.filter(F.col(PART).isin(chosen)).drop(PART))
            placed = rows.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(n_parts)).cast("int"))
            writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART)
            writer.parquet(f"{path}/rows")
            for part in chosen:
                commit_json(spark, f"{path}/ledger/{part}.json", {"part": part})
    return read_parts(df, work, path)


def read_parts(df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """The finished rows, with the columns that ``work`` gives."""
    schema = work(df.limit(0)).schema
    done = finished_parts(df, path)
    placed = T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())])
    reader = df.sparkSession.read.schema(placed).option("basePath", f"{path}/rows")
    there = [n for n in list_names(df.sparkSession, f"{path}/rows") if n.startswith(f"{PART}=") and int(n[len(PART) + 1 :]) in done]
    if not there:
        return df.sparkSession.createDataFrame([], schema)
    return reader.parquet(*[f"{path}/rows/{n}" for n in there]).drop(PART)
