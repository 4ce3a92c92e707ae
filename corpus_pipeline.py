"""A corpus pipeline: each stage takes what its predecessor kept and is written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import byte_bpe, decontaminate, simhash_dedup, suffix_dedup, toxicity
from pairloom.llm.common import fold, table
from pairloom.llm.queries import RANKS
from pairloom.scratch import write_scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the grammar is learned from labels outside the held-out fold."""
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return toxicity.score_texts(docs, grammar).filter("predicted = 0").drop("score", "predicted")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints of three-word shingles, two bits or fewer apart."""
    return simhash_dedup.one_of_each(docs, width=3, distance=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats an earlier 100 bytes; a document may be left empty, but stays."""
    left = suffix_dedup.remove_repeats(docs, as_text=True).withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")})
    return left.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left."""
    return byte_bpe.token_digests(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("tokens", tokenize),
]

# Learned scores, reached components and byte-exact marks have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
