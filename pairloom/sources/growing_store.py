"""A vector store that grows: generations of files, and a manifest that says which of them count.

``<path>/generations/<name>`` holds the rows of one append, laid out by group (``vector_tables``), and
``<path>/directories/<name>`` says which of its files hold which group, with the number of rows.
``<path>/manifests/<version>.json`` lists the generations that make up a version, and the next free
id. An append writes its generation first and then commits the next manifest by one rename. So a
reader sees an append whole or not at all; what a failed append has written is in no manifest, and
of two appends at a time one has to be made again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.row_index import number_rows
from pairloom.scratch import write_scratch
from pairloom.sources.files import commit_json, list_names, read_json, remove
from pairloom.sources.vector_tables import write_grouped

_DIGITS = 10  # of a version in a manifest's name, so that names sort as versions do


@dataclass(frozen=True)
class GrowingStore:
    """One version of a store. ``generations`` has name and rows of each."""

    spark: SparkSession
    path: str
    version: int
    group: str
    vec_id: str
    n_buckets: int
    next_id: int
    schema: T.StructType
    generations: tuple[tuple[str, int], ...]

    # ------------------------------------------------------------ reading

    def table(self) -> DataFrame:
        """All rows of this version."""
        if not self.generations:
            return self.spark.createDataFrame([], self.schema)
        return self._read([f"{self.path}/generations/{name}" for name, _ in self.generations])

    def directory(self) -> DataFrame:
        """``(group, file, rows)`` for every file of this version that holds a group."""
        kind = T.StructType([self.schema[self.group], T.StructField("file", T.StringType()), T.StructField("rows", T.LongType())])
        if not self.generations:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/directories/{name}" for name, _ in self.generations])

    def files_of(self, wanted: DataFrame) -> list[str]:
        """The files that hold a group of a table with the same group column: names only, at most those of
        this version."""
        groups = wanted.select(F.col(self.group).cast(self.schema[self.group].dataType)).filter(F.col(self.group).isNotNull()).distinct()
        held = self.directory().join(groups, self.group, "left_semi").select("file").distinct()
        return sorted(f"{self.path}/generations/{row['file']}" for row in held.collect())

    def rows_of(self, wanted: DataFrame) -> DataFrame:
        """The rows of all files that hold a group of ``wanted``; no other file is listed or opened. Other groups
        of these files come along."""
        files = self.files_of(wanted)
        return self._read(files) if files else self.spark.createDataFrame([], self.schema)

    def _read(self, paths: list[str]) -> DataFrame:
        return _reader(self.spark, self.schema).parquet(*paths)

    # ------------------------------------------------------------ writing

    def append(self, rows: DataFrame, *order_by: str | Column, unique: bool = False) -> GrowingStore:
        """The next version, with ``rows`` under ids that go on from the highest one, in the given order.

        ``rows`` has the store's columns but the id's. Fails with ``Taken`` if another append was
        committed since this version was opened: open the store and append again.
        """
        given = [name for name in self.schema.names if name != self.vec_id]
        numbered = number_rows(rows.select(*given), *order_by, name=self.vec_id, unique=unique)
        placed = numbered.withColumn(self.vec_id, F.col(self.vec_id) + F.lit(self.next_id))
        name, n = self.write_generation(placed)
        return self._commit(self.next_id + n, (*self.generations, (name, n)))

    def write_generation(self, rows: DataFrame) -> tuple[str, int]:
        """Files and directory of a generation that no manifest lists yet; its name and number of rows."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/generations/{name}"
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        write_grouped(typed, folder, self.group, self.n_buckets, mode="error")
        held = _reader(self.spark, self.schema).parquet(folder)
        # The part of a file's path below the generations, which does not change if the store is moved.
        file = F.concat(F.lit(f"{name}/"), F.substring_index("_metadata.file_path", f"/{name}/", -1))
        counted = held.select(self.group, file.alias("file")).groupBy(self.group, "file").agg(F.count("*").alias("rows"))
        counted = write_scratch(counted, "directory")
        directory = counted.repartitionByRange(max(1, -(-counted.count() // 1_000_000)), self.group).sortWithinPartitions(self.group)
        directory.write.mode("error").parquet(f"{self.path}/directories/{name}")
        return name, counted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def compact(self, small: int) -> GrowingStore:
        """The next version, with all generations of fewer than ``small`` rows written as one. Rows and ids
        stay; the old files do too, for readers of older versions, until ``vacuum``."""
        few = [g for g in self.generations if g[1] < small]
        if len(few) < 2:
            return self
        rows = self._read([f"{self.path}/generations/{name}" for name, _ in few])
        merged = self.write_generation(rows)
        return self._commit(self.next_id, (*(g for g in self.generations if g not in few), merged))

    def vacuum(self) -> list[str]:
        """Delete all generations that this version, which must be the newest, does not list: those of
        failed appends and of older versions. Nobody may append or read older versions meanwhile."""
        if _versions(self.spark, self.path)[-1] != self.version:
            raise ValueError("only the newest version can tell what is not needed")
        listed = {name for name, _ in self.generations}
        gone = [name for name in list_names(self.spark, f"{self.path}/generations") if name not in listed]
        for name in gone:
            remove(self.spark, f"{self.path}/directories/{name}")
            remove(self.spark, f"{self.path}/generations/{name}")
        return gone

    def _commit(self, next_id: int, generations: Sequence[tuple[str, int]]) -> GrowingStore:
        content = {
            "group": self.group, "vec_id": self.vec_id, "n_buckets": self.n_buckets, "next_id": next_id,
            "schema": self.schema.jsonValue(), "generations": [list(g) for g in generations],
        }
        commit_json(self.spark, _manifest(self.path, self.version + 1), content)
        return open_growing(self.spark, self.path, self.version + 1)


def _reader(spark: SparkSession, schema: T.StructType) -> DataFrameReader:
    """Reads files of several generations at a time; the folders' names hold nothing that the rows need."""
    return spark.read.schema(schema).option("recursiveFileLookup", True)


def _manifest(path: str, version: int) -> str:
    return f"{path}/manifests/{version:0{_DIGITS}d}.json"


def _versions(spark: SparkSession, path: str) -> list[int]:
    return [int(name[:_DIGITS]) for name in list_names(spark, f"{path}/manifests") if name.endswith(".json") and name[:_DIGITS].isdigit()]


def create_growing(spark: SparkSession, path: str, schema: T.StructType, group: str, n_buckets: int, vec_id: str = "vec_id") -> GrowingStore:
    """An empty store for rows of this schema, which has the group and a long id. Fails if there is one."""
    if not isinstance(schema[vec_id].dataType, T.LongType) or group not in schema.names:
        raise ValueError("a store needs its group and an id of type long")
    nothing = GrowingStore(spark, path.rstrip("/"), -1, group, vec_id, n_buckets, 0, schema, ())
    return nothing._commit(0, ())


def open_growing(spark: SparkSession, path: str, version: int | None = None) -> GrowingStore:
    """The newest version of a store, or a given one."""
    path = path.rstrip("/")
    if version is None:
        known = _versions(spark, path)
        if not known:
            raise ValueError(f"no store at {path}")
        version = known[-1]
    m = read_json(spark, _manifest(path, version))
    generations = tuple((name, rows) for name, rows in m["generations"])
    return GrowingStore(spark, path, version, m["group"], m["vec_id"], m["n_buckets"], m["next_id"], T.StructType.fromJson(m["schema"]), generations)
