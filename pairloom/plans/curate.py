"""The curation job: score pairs, write what passes, keep what does not with its reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import reject_reason
from pairloom.session import spread
from pairloom.sources.bitext import NA_TOKENS, csv_writer, read_bitext

KEPT = "kept"
OUTCOMES = (KEPT, "null_source", "null_target", "letter_spread", "nonletter_ratio")


def with_outcome(df: DataFrame, source: str, target: str, **gate) -> DataFrame:
    """Pairs with their outcome: ``kept`` or a reject reason."""
    reason = reject_reason(F.col(source), F.col(target), **gate)
    return df.withColumn("outcome", F.coalesce(reason, F.lit(KEPT)))


def write_outcomes(pairs: DataFrame, path: str, source: str, target: str, header: bool = True, **gate) -> dict[str, int]:
    """Write pairs to one folder per outcome, and return the rows of each.

    One narrow stage: pairs are read and scored once, each task writes one file per outcome it
    meets, and the counts are observed on the way. ``<path>/outcome=kept`` is the clean CSV.
    """
    counts = Observation()
    scored = with_outcome(pairs.select(source, target), source, target, **gate).observe(
        counts, *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    )
    csv_writer(scored, header).partitionBy("outcome").csv(path)
    return {outcome: counts.get[outcome] for outcome in OUTCOMES}


def curate_bitext(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    source: str = "english",
    target: str = "german",
    multiline: bool = True,
    header: bool = True,
    **gate,
) -> dict[str, int]:
    """Read a bitext CSV, and write kept and rejected pairs, with or without a header."""
    pairs = read_bitext(spark, input_path, source, target, multiline=multiline, na_tokens=NA_TOKENS)
    return write_outcomes(spread(pairs), output_path, source, target, header, **gate)


def kept_path(output_path: str) -> str:
    return f"{output_path}/outcome={KEPT}"
