"""The curation job over files as they arrive: same gate, same layout, and counts that a replay does not double."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairloom.plans.curate import OUTCOMES, with_outcome
from pairloom.sources.bitext import NA_TOKENS, csv_writer, nullify_tokens


def curate_stream(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    checkpoint_dir: str,
    source: str = "english",
    target: str = "german",
    multiline: bool = True,
    files_per_trigger: int = 1000,
    **gate,
) -> StreamingQuery:
    """Start a query that curates all new files in ``input_dir``, then stops.

    Each pair is scored on its own, so the query keeps no state. Pairs go to ``outcome=.../batch=...``, and
    the number of each outcome in the batch to ``_counts/batch=...``. A batch that is run again, after a
    failure in the middle of it, replaces its own folders; so, with the checkpoint in a shared
    folder, each file counts once. Columns are found by name in the header of the files that
    are there at the start; a later file with another header fails. An empty folder is taken to
    get files of the two columns.
    """
    columns = [source, target]
    try:
        columns = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(input_dir).columns or columns
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    pairs = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(input_dir)
        .select(source, target)
    )
    scored = with_outcome(nullify_tokens(pairs, [source, target], NA_TOKENS), source, target, **gate)

    def write_batch(batch: DataFrame, number: int) -> None:
        counts = Observation()
        placed = batch.withColumn("batch", F.lit(number).cast("long"))
        placed = placed.observe(counts, *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
        writer = csv_writer(placed).option("partitionOverwriteMode", "dynamic").partitionBy("outcome", "batch")
        writer.csv(output_dir)
        found = [(o, counts.get[o]) for o in OUTCOMES]
        told = batch.sparkSession.createDataFrame(found, "outcome string, n long").coalesce(1)
        told.write.mode("overwrite").parquet(f"{output_dir}/_counts/batch={number}")

    return (
        scored.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_counts(spark: SparkSession, output_dir: str) -> DataFrame:
    """``(outcome, n)`` over all batches that the query has finished."""
    counts = spark.read.schema("outcome string, n long, batch long").parquet(f"{output_dir}/_counts")
    return counts.groupBy("outcome").agg(F.sum("n").alias("n")).filter("n > 0")
