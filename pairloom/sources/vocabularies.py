"""Vocabularies that are kept between jobs.

``<path>/tokens/<name>`` holds the rows of one version, bucketed and sorted by token, and
``<path>/manifests/<version>.json`` says what it is; see ``growing_store`` for why a reader sees a
version whole or not at all. As the files are bucketed by token, a join of tokens with a large
vocabulary shuffles the tokens only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.row_index import index_rows
from pairloom.operators.tokens import Vocabulary, count_tokens
from pairloom.sources.files import commit_json, list_names, read_json

_COLUMNS = "token_id INT, token STRING, n BIGINT"
_DIGITS = 10


def _known(spark: SparkSession, path: str) -> list[int]:
    return [int(name[:_DIGITS]) for name in list_names(spark, f"{path}/manifests") if name.endswith(".json") and name[:_DIGITS].isdigit()]


def _bucketed(spark: SparkSession, folder: str, n_buckets: int) -> DataFrame:
    """The rows of a folder as a table whose buckets the planner knows: a name in this session's catalog."""
    name = f"pairloom_vocabulary_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"
    if not spark.catalog.tableExists(name):
        place = folder.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({_COLUMNS}) USING parquet CLUSTERED BY (token) SORTED BY (token) INTO {n_buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def save_vocabulary(vocabulary: Vocabulary, path: str, n_buckets: int = 64) -> Vocabulary:
    """Keep a vocabulary as the next version at ``path``; what comes back reads the kept files.

    For joins without a shuffle on its side, give as many buckets as jobs have shuffle partitions.
    """
    spark, path = vocabulary.table.sparkSession, path.rstrip("/")
    known = _known(spark, path)
    version = known[-1] + 1 if known else 0
    folder, name = f"{path}/tokens/{uuid.uuid4().hex}", f"pairloom_writing_{uuid.uuid4().hex}"
    rows = vocabulary.table.select("token_id", "token", "n").repartition(n_buckets, "token")
    rows.write.bucketBy(n_buckets, "token").sortBy("token").option("path", folder).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog only: the files have a path of their own
    content = {"folder": folder[len(path) + 1 :], "n_buckets": n_buckets, "size": vocabulary.size, "n_bytes": vocabulary.n_bytes, "reserved": list(vocabulary.reserved)}
    commit_json(spark, f"{path}/manifests/{version:0{_DIGITS}d}.json", content)
    return open_vocabulary(spark, path, version)


def open_vocabulary(spark: SparkSession, path: str, version: int | None = None) -> Vocabulary:
    """The newest version of a kept vocabulary, or a given one."""
    path = path.rstrip("/")
    if version is None:
        known = _known(spark, path)
        if not known:
            raise ValueError(f"no vocabulary at {path}")
        version = known[-1]
    m = read_json(spark, f"{path}/manifests/{version:0{_DIGITS}d}.json")
    return Vocabulary(_bucketed(spark, f"{path}/{m['folder']}", m["n_buckets"]), m["size"], m["n_bytes"], tuple(m["reserved"]))


def extend_vocabulary(vocabulary: Vocabulary, df: DataFrame, *token_columns: str, least: int = 1) -> Vocabulary:
    """The vocabulary with the tokens of ``df`` that it lacks and that come ``least`` times there: they get the
    next ids, by (count falling, token). Old tokens keep their ids and counts. Save it to keep it."""
    fresh = count_tokens(df, *token_columns).filter(F.col("n") >= least)
    fresh = fresh.join(vocabulary.table.select("token"), "token", "left_anti")
    ranked = index_rows(fresh, F.col("n").desc(), "token", unique=["token"])
    more = ranked.table().select((F.col("row_idx") + vocabulary.size).cast("int").alias("token_id"), "token", "n")
    n_bytes = more.agg(F.coalesce(F.sum(F.octet_length("token") + 8), F.lit(0))).first()[0]
    table = vocabulary.table.select("token_id", "token", "n").unionByName(more)
    return Vocabulary(table, vocabulary.size + ranked.total, vocabulary.n_bytes + n_bytes, vocabulary.reserved)
