"""Gap-free 0-based row numbers over a whole table, without a one-partition window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.rows import attach
from pairloom.scratch import write_scratch
from pairloom.sources.files import commit_json, read_json

_SLOT = "__slot"  # partition in the high bits, position in it in the low 33 bits
_POSITION_BITS = 33
RANGE_BYTES = 128 << 20  # measured bytes per range
MAX_RANGES = 1 << 20  # what a row count per range may take on the driver; ranges grow only beyond 128 TB


@dataclass(frozen=True)
class RowIndex:
    """An ordered table: ``stored`` holds the rows with their slots, ``spans`` holds
    ``(partition, first row number, rows)``, one entry per non-empty range partition."""

    stored: DataFrame
    spans: tuple[tuple[int, int, int], ...]
    name: str = "row_idx"

    @property
    def total(self) -> int:
        return sum(rows for _, _, rows in self.spans)

    def table(self) -> DataFrame:
        """All rows with their number."""
        return self._numbered(self.stored, self.spans)

    def between(self, low: int, high: int) -> DataFrame:
        """Rows ``low`` up to, but without, ``high``. The range is turned into slot ranges, so
        the scan skips row groups that cannot hold it."""
        hits = [span for span in self.spans if span[1] < high and span[1] + span[2] > low]
        if not hits:
            return self._numbered(self.stored.filter(F.lit(False)), ())
        (p0, s0, _), (p1, s1, n1) = hits[0], hits[-1]
        first = (p0 << _POSITION_BITS) + max(low - s0, 0)
        last = (p1 << _POSITION_BITS) + min(high - s1, n1) - 1
        return self._numbered(self.stored.filter(F.col(_SLOT).between(first, last)), hits)

    def at(self, index: int) -> DataFrame:
        """The row with this number; no row if it is out of range."""
        return self.between(index, index + 1)

    def _numbered(self, rows: DataFrame, spans) -> DataFrame:
        position = F.col(_SLOT).bitwiseAND((1 << _POSITION_BITS) - 1)
        if len(spans) <= 1:
            start = spans[0][1] if spans else 0
            return rows.withColumn(self.name, position + F.lit(start).cast("long")).drop(_SLOT)
        # One row per range partition: bounded by the number of shuffle partitions.
        starts = rows.sparkSession.createDataFrame(
            pa.table(
                {"__part": [s[0] for s in spans], "__start": [s[1] for s in spans]},
                pa.schema([("__part", pa.int64()), ("__start", pa.int64())]),
            )
        )
        return (
            rows.withColumn("__part", F.shiftright(_SLOT, _POSITION_BITS))
            .join(F.broadcast(starts), "__part")
            .withColumn(self.name, F.col("__start") + position)
            .drop("__part", "__start", _SLOT)
        )


def _row_hash(df: DataFrame) -> Column:
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.xxhash64(*hashable)


def _row_bytes(kind: T.DataType, value: Column) -> Column:
    """Bytes that a value takes in memory, about, from its own lengths; a null counts as one of no length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.ArrayType):
        size = F.greatest(F.size(value), F.lit(0)).cast("long")
        if isinstance(kind.elementType, T.AtomicType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType)):
            return size * 8 + 8
        held = F.aggregate(value, F.lit(8).cast("long"), lambda total, x: total + _row_bytes(kind.elementType, x))
        return F.coalesce(held, F.lit(8).cast("long"))
    if isinstance(kind, T.MapType):
        return _row_bytes(T.ArrayType(kind.keyType), F.map_keys(value)) + _row_bytes(T.ArrayType(kind.valueType), F.map_values(value))
    if isinstance(kind, T.StructType):
        return sum((_row_bytes(f.dataType, value[f.name]) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is one stored table with columns picked, renamed or filtered: cheap to read again."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def _staged(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` to be read again cheaply, and its size in bytes, measured row by row.

    The planner's own estimate is no measure: without statistics a join counts as the product of
    its sides. A scan is measured by one pass over it. Anything else is written on the way, so
    that what the range bounds are sampled from and what is shuffled is worked out once.
    """
    row = sum((_row_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0).cast("long"))
    total = F.sum(row).alias("bytes")
    if _is_scan(df):
        return df, df.agg(total).first()[0] or 0
    seen = Observation()
    stored = write_scratch(df.observe(seen, total), "unordered")
    return stored, seen.get.get("bytes") or 0


def _range_count(n_bytes: int, usual: int) -> int:
    """Number of ranges for a table of this measured size: one per MB up to ``usual``, the session's
    number of shuffle partitions; beyond that, as many as keep a range at ``RANGE_BYTES``.

    A fixed number keeps adaptive execution from joining ranges by their compressed size, which
    would put a mass of copies, being small when compressed, in a few tasks again.
    """
    return max(1, min(usual, n_bytes >> 20), min(-(-n_bytes // RANGE_BYTES), MAX_RANGES))


def index_rows(
    df: DataFrame,
    *order_by: str | Column,
    name: str = "row_idx",
    unique: bool | Sequence[str] = False,
    partitions: int | None = None,
    path: str | None = None,
) -> RowIndex:
    """Number the rows of ``df`` in the given order.

    The rows are measured, and written if they are more than a scan; one range shuffle orders them,
    and they are written with each row's partition and position in it. Row counts per partition give the
    starting numbers. The ordered table must be written because range bounds come from a sample
    and would differ between two passes.

    Set ``unique`` if the order columns, which must be names then, already tell rows apart, or to
    the names of columns that do. This is checked, and the index fails if two rows share them.
    Otherwise equal keys are ordered by a hash of the whole row, and whole copies by the input partition they come
    from. So neither a hot key nor a hot group of copies ends up in one range: at most one
    input partition's share of copies stays together. That partition is the same whenever a
    task runs again.

    The number of ranges follows the measured size, unless given. With a ``path`` the index is kept
    there, and ``open_index`` opens it again without a pass over the rows.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    columns = df.columns
    if not unique:
        df = df.withColumns({"__row": _row_hash(df), "__from": F.spark_partition_id()})
        keys += [F.col("__row"), F.col("__from")]
    staged, n_bytes = _staged(df)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        staged.repartitionByRange(partitions or _range_count(n_bytes, usual), *keys)
        .sortWithinPartitions(*keys)
        .select(*columns, F.monotonically_increasing_id().alias(_SLOT))
    )
    if path is None:
        stored = write_scratch(ordered, "rows")
    else:
        ordered.write.mode("error").parquet(f"{path}/rows")
        stored = df.sparkSession.read.schema(ordered.schema).parquet(f"{path}/rows")
    if unique:
        _require_unique(stored, list(order_by) if unique is True else list(unique))
    part = F.shiftright(_SLOT, _POSITION_BITS).alias("part")
    if path is not None:
        return _kept(stored, part, path, name)
    counts = stored.groupBy(part).agg(F.count("*").alias("rows")).collect()  # one row per range partition
    return RowIndex(stored, _spans([(c["part"], c["rows"]) for c in counts]), name)


def _spans(counts: list[tuple[int, int]]) -> tuple[tuple[int, int, int], ...]:
    """Partition, first row number and rows, from rows by partition."""
    spans, start = [], 0
    for part, rows in sorted(counts):
        spans.append((part, start, rows))
        start += rows
    return tuple(spans)


@dataclass(frozen=True)
class StoredIndex(RowIndex):
    """A kept index. It knows the file of every span, so a lookup opens only files that hold its rows."""

    files: tuple[str, ...] = ()

    def between(self, low: int, high: int) -> DataFrame:
        hits = [i for i, (_, start, rows) in enumerate(self.spans) if start < high and start + rows > low]
        if not hits:
            return super().between(low, high)
        spark, schema = self.stored.sparkSession, self.stored.schema
        rows = spark.read.schema(schema).parquet(*sorted({self.files[i] for i in hits}))
        return RowIndex(rows, self.spans, self.name).between(low, high)


def _kept(stored: DataFrame, part: Column, path: str, name: str) -> StoredIndex:
    """Write the spans of rows that are at ``path``; without them the index is not there."""
    spark = stored.sparkSession
    file = F.substring_index("_metadata.file_path", "/", -1).alias("file")
    counts = stored.select(part, file).groupBy("part", "file").agg(F.count("*").alias("rows"))
    listed = [[r["part"], r["file"], r["rows"]] for r in counts.collect()]  # a row per file
    if len({r[0] for r in listed}) != len(listed):
        raise ValueError("a range was written to more than one file: unset spark.sql.files.maxRecordsPerFile")
    commit_json(spark, f"{path}/index.json", {"name": name, "schema": stored.schema.jsonValue(), "spans": sorted(listed)})
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    """An index that ``index_rows`` has kept. Only its list of spans is read."""
    kept = read_json(spark, f"{path}/index.json")
    spans = _spans([(part, rows) for part, _, rows in kept["spans"]])
    files = tuple(f"{path}/rows/{file}" for _, file, _ in kept["spans"])
    stored = spark.read.schema(T.StructType.fromJson(kept["schema"])).parquet(f"{path}/rows")
    return StoredIndex(stored, spans, kept["name"], files)


def _require_unique(df: DataFrame, names: list) -> None:
    """Fails if two rows share the named columns. Only hashes are shuffled; the rows of hashes that
    come twice, which are none or few, are compared by value."""
    if not all(isinstance(n, str) for n in names):
        raise ValueError("name the columns that tell rows apart")
    digest = F.xxhash64(*names).alias("__digest")
    twice = df.select(digest).groupBy("__digest").count().filter("count > 1").select("__digest")
    if not twice.isEmpty():
        same = df.select(*names, digest).join(twice, "__digest", "left_semi").groupBy(*names).count().filter("count > 1").first()
        if same is not None:
            raise ValueError(f"{names} do not tell rows apart: {same.asDict()}")


def number_rows(
    df: DataFrame, *order_by: str | Column, name: str = "row_idx", unique: bool = False
) -> DataFrame:
    """The rows of ``df`` with their number.

    If column names that tell rows apart give the order, only those columns are written, sorted and
    numbered, and the numbers are joined back to the other columns.
    """
    if not unique or not all(isinstance(c, str) for c in order_by) or set(order_by) == set(df.columns):
        return index_rows(df, *order_by, name=name, unique=unique).table()
    numbers = index_rows(df.select(*order_by), *order_by, name=name, unique=True).table()
    return attach(df, numbers, order_by)


def first_rows(df: DataFrame, n: int, *order_by: str | Column) -> DataFrame:
    """The first ``n`` rows in the given order; each task passes on at most ``n``."""
    return df.orderBy(*order_by).limit(n)
