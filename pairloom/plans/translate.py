"""The translation job: the model's text for each source, with the gate's verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.batching import BATCH_SIZE
from pairloom.operators.scoring import TextModel, score_text


def translate(
    df: DataFrame,
    source: str,
    make_model: Callable[[], TextModel],
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """All rows with ``translation``, a struct of ``output_text`` and ``quality_ok``."""
    scored = score_text(df, source, make_model, "__text", "__ok", batch_size)
    result = F.struct(F.col("__text").alias("output_text"), F.col("__ok").alias("quality_ok"))
    return scored.withColumn("translation", result).drop("__text", "__ok")
