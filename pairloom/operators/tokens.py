"""Tokenizing, vocabularies, and moving between tokens and ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import arrays as ar
from pairloom.functions.text import word_tokens
from pairloom.operators.row_index import index_rows
from pairloom.operators.rows import attach
from pairloom.scratch import write_scratch
from pairloom.session import ship_package

PAD, END, UNKNOWN = "<pad>", "</s>", "<unk>"

# A vocabulary up to this size is sent to every worker; a larger one is joined.
# 16 MB are about a million words, and a dictionary of some 150 MB in each worker.
SHARED_VOCABULARY_BYTES = 16 << 20
# Of a joined vocabulary the most frequent tokens, at most this many, are broadcast.
HEAD_TOKENS = 200_000
HEAD_TOKEN_BYTES = 256

Tokenizer = Callable[[Column], Column]


def tokenize(
    df: DataFrame, text: str, name: str = "tokens", tokenizer: Tokenizer = word_tokens
) -> DataFrame:
    """Add the tokens of a text column. The tokenizer maps a column to an array column: a
    built-in expression or the caller's pandas/Arrow UDF."""
    return df.withColumn(name, tokenizer(F.col(text)))


def tokenize_pair(
    df: DataFrame,
    source: str,
    target: str,
    source_tokenizer: Tokenizer = word_tokens,
    target_tokenizer: Tokenizer = word_tokens,
) -> DataFrame:
    """Add ``source_tokens`` and ``target_tokens``, each side with its own settings."""
    return df.withColumns(
        {
            "source_tokens": source_tokenizer(F.col(source)),
            "target_tokens": target_tokenizer(F.col(target)),
        }
    )


@dataclass(frozen=True)
class Vocabulary:
    """A written table ``(token_id, token, n)`` with ids from 0 without gaps, reserved tokens
    first, then by falling frequency."""

    table: DataFrame
    size: int
    n_bytes: int
    reserved: tuple[str, ...]

    def reserved_id(self, token: str) -> int:
        return self.reserved.index(token)

    @property
    def reserved_ids(self) -> list[int]:
        return list(range(len(self.reserved)))

    @property
    def special_ids(self) -> list[int]:
        """Ids that stand for no token of a text. An unknown token is one of the text's own."""
        return [i for i, token in enumerate(self.reserved) if token != UNKNOWN]

    @property
    def fits_in_workers(self) -> bool:
        return self.n_bytes <= SHARED_VOCABULARY_BYTES

    def in_order(self) -> pa.Array:
        """All tokens by id, on the driver; only for a vocabulary within the size limit."""
        if not self.fits_in_workers:
            raise ValueError(f"vocabulary of {self.n_bytes} bytes is too large to share")
        listed = self.table.select("token_id", "token").toArrow().sort_by("token_id")
        return listed.column("token").combine_chunks().cast(pa.string())


    @cached_property
    def shared(self):
        """A mark of this vocabulary and its tokens, broadcast once for all lookups."""
        ship_package(self.table.sparkSession)
        return uuid.uuid4().hex, self.table.sparkSession.sparkContext.broadcast(self.in_order())


def count_tokens(df: DataFrame, *token_columns: str) -> DataFrame:
    """``(token, n)`` of all given columns."""
    every = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in token_columns]))
    return df.select(F.explode(every).alias("token")).filter("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n"))


def build_vocabulary(
    df: DataFrame, *token_columns: str, reserved: Sequence[str] = (PAD, END, UNKNOWN), least: int = 1
) -> Vocabulary:
    """Count the tokens of all given columns and number them by (count falling, token). Tokens that come
    fewer than ``least`` times are left out, and so are unknown to ``encode``.

    Counts are combined in each task before the shuffle, so a frequent token is no hot key,
    and the numbering is a distributed row index.
    """
    reserved = tuple(reserved)
    counts = count_tokens(df, *token_columns).filter((F.col("n") >= least) & ~F.col("token").isin(*reserved))
    ranked = index_rows(counts, F.col("n").desc(), "token", unique=["token"])
    head = df.sparkSession.createDataFrame(
        [(i, token, 0) for i, token in enumerate(reserved)], "token_id int, token string, n long"
    )
    # The index is written already: numbers are added to its rows as they are read.
    table = head.unionByName(
        ranked.table().select((F.col("row_idx") + len(reserved)).cast("int").alias("token_id"), "token", "n")
    )
    n_bytes = table.agg(F.sum(F.octet_length("token") + 8)).first()[0]
    return Vocabulary(table, ranked.total + len(reserved), n_bytes or 0, reserved)


def encode(
    df: DataFrame,
    tokens: str,
    vocabulary: Vocabulary,
    name: str = "ids",
    prefix: Sequence[int] = (),
    suffix: Sequence[int] = (),
    shared: bool | None = None,
) -> DataFrame:
    """Add the ids of a token column, between fixed prefix and suffix ids.

    A vocabulary within the size limit is looked up in place, batch by batch, with no shuffle; a
    larger one is joined, with the same result. ``shared`` overrides the choice.
    """
    out = encode_sides(df, {tokens: name}, vocabulary, shared)
    lead = F.array(*[F.lit(i) for i in prefix]).cast("array<int>")
    tail = F.array(*[F.lit(i) for i in suffix]).cast("array<int>")
    return out.withColumn(name, F.concat(lead, F.col(name), tail)) if prefix or suffix else out


def encode_sides(df: DataFrame, columns: Mapping[str, str], vocabulary: Vocabulary, shared: bool | None = None) -> DataFrame:
    """Add the ids of several token columns, each under the name given for it. A large vocabulary is joined once
    for all of them."""
    if vocabulary.fits_in_workers if shared is None else shared:
        lookup = _shared_lookup(vocabulary, encoding=True)
        return df.withColumns({name: lookup(F.col(column)) for column, name in columns.items()})
    return _joined_lookup(df, columns, vocabulary, encoding=True)


def ids_to_tokens(
    df: DataFrame,
    ids: str,
    vocabulary: Vocabulary,
    name: str = "tokens",
    shared: bool | None = None,
) -> DataFrame:
    """Add the token strings of an id column, reserved tokens included."""
    return decode_sides(df, {ids: name}, vocabulary, shared)


def decode_sides(df: DataFrame, columns: Mapping[str, str], vocabulary: Vocabulary, shared: bool | None = None) -> DataFrame:
    """Add the token strings of several id columns, each under the name given for it. A large vocabulary is joined
    once for all of them."""
    if vocabulary.fits_in_workers if shared is None else shared:
        lookup = _shared_lookup(vocabulary, encoding=False)
        return df.withColumns({name: lookup(F.col(column)) for column, name in columns.items()})
    return _joined_lookup(df, columns, vocabulary, encoding=False)


def batch_decode(
    df: DataFrame,
    ids: str,
    vocabulary: Vocabulary,
    name: str = "text",
    separator: str = " ",
    shared: bool | None = None,
) -> DataFrame:
    """Add the text of an id column, reserved tokens left out."""
    kept = df.withColumn(
        "__kept", F.filter(ids, lambda x: ~x.isin(*vocabulary.reserved_ids))
    )
    decoded = ids_to_tokens(kept, "__kept", vocabulary, "__tokens", shared)
    return decoded.withColumn(name, F.array_join("__tokens", separator)).drop("__kept", "__tokens")


def lang_prefix(
    df: DataFrame, lang: str, ids: str, lang_ids: DataFrame, max_broadcast_rows: int = 10_000
) -> DataFrame:
    """Put the id of the row's language code before its ids; an unknown code fails the job.

    ``lang_ids`` is ``(lang_code, token_id)``. It is broadcast if it has as few rows as a list
    of languages should; otherwise the planner chooses the join.
    """
    codes = lang_ids.select(F.col("lang_code").alias("__code"), F.col("token_id").alias("__lang_id"))
    if len(codes.take(max_broadcast_rows + 1)) <= max_broadcast_rows:
        codes = F.broadcast(codes)
    checked = F.when(F.col("__lang_id").isNotNull(), F.col("__lang_id")).otherwise(
        F.raise_error(F.concat(F.lit("unknown language code: "), F.coalesce(lang, F.lit("null")))).cast("int")
    )
    return (
        df.join(codes, F.col(lang) == F.col("__code"), "left")
        .withColumn(ids, F.array_prepend(ids, checked))
        .drop("__code", "__lang_id")
    )


def unroll_prefixes(df: DataFrame, key: str | Sequence[str], ids: str) -> DataFrame:
    """One row ``(key, n, last_id)`` per prefix of the ids: its length, and the id it ends with.

    Prefixes are not written out, which would take the square of a text's length; the ids of the
    rows up to ``n`` are the prefix.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, F.posexplode(ids).alias("n", "last_id")).withColumn("n", F.col("n") + 1)


_ids: dict[str, dict[str, int]] = {}


def _ids_by_token(mark: str, shared) -> dict[str, int]:
    """Ids of a broadcast vocabulary, built once per Python worker process. A worker keeps one
    vocabulary at a time."""
    if mark not in _ids:
        _ids.clear()
        _ids[mark] = {token: i for i, token in enumerate(shared.value.to_pylist())}
    return _ids[mark]


def _shared_lookup(vocabulary: Vocabulary, encoding: bool):
    """Arrow UDF that maps whole arrays against a vocabulary sent to the workers once."""
    mark, shared = vocabulary.shared
    unknown = vocabulary.reserved_id(UNKNOWN)

    if encoding:

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def lookup(tokens: pa.Array) -> pa.Array:
            # Each distinct token of the batch is looked up once.
            coded = tokens.flatten().dictionary_encode()
            ids = _ids_by_token(mark, shared)
            found = pa.array([ids.get(t, unknown) for t in coded.dictionary.to_pylist()], pa.int32())
            return _mapped(tokens, pc.fill_null(found.take(coded.indices), unknown))

    else:

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def lookup(ids: pa.Array) -> pa.Array:
            flat = ids.flatten()
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(shared.value)))
            safe = pc.if_else(pc.fill_null(known, False), flat, unknown)
            return _mapped(ids, shared.value.take(safe))

    return lookup


def _mapped(lists: pa.Array, values: pa.Array) -> pa.Array:
    """Lists of the same lengths, and nulls in the same places, with other values."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(sizes).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null())


def _head(vocabulary: Vocabulary, head: DataFrame):
    """A mark of the vocabulary's head and its tokens by id, broadcast; null where a token is too long."""
    ship_package(head.sparkSession)
    listed = head.toArrow().sort_by("token_id")
    return uuid.uuid4().hex, head.sparkSession.sparkContext.broadcast(listed.column("token").combine_chunks().cast(pa.string()))


def _open_ones(rows: np.ndarray, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values of each row: all of them row by row, how many each row has, and for each of the
    given values its place among those of its row."""
    width = int(values.max()) + 1 if len(values) else 1
    different, back = np.unique(rows * width + values, return_inverse=True)
    of = different // width
    place = np.arange(len(of)) - np.searchsorted(of, of)
    return different % width, np.bincount(of, minlength=n_rows), place[back]


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)


def _rows_of(lists: pa.Array) -> np.ndarray:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists), dtype=np.int64), sizes)


def _head_encoder(vocabulary: Vocabulary, mark: str, shared):
    """Arrow UDF ``tokens -> (near, open)``: ids as far as the head has them, and the row's different tokens that
    it lacks; in ``near`` the one at place ``i`` stands as ``-1 - i``."""
    unknown = vocabulary.reserved_id(UNKNOWN)

    @F.arrow_udf(T.StructType([T.StructField("near", T.ArrayType(T.IntegerType())), T.StructField("open", T.ArrayType(T.StringType()))]))
    def near(tokens: pa.Array) -> pa.Array:
        coded = tokens.flatten().dictionary_encode()
        ids = _ids_by_token(mark, shared)
        known = np.array([ids.get(t, -1) for t in coded.dictionary.to_pylist()] + [unknown], np.int32)
        code = pc.fill_null(coded.indices, len(known) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        found = known[code]
        missed = np.flatnonzero(found < 0)
        open_codes, lengths, place = _open_ones(_rows_of(tokens)[missed], code[missed], len(tokens))
        found[missed] = -1 - place
        open_tokens = _lists(coded.dictionary.take(pa.array(open_codes)).cast(pa.string()), lengths)
        return pa.StructArray.from_arrays([_mapped(tokens, pa.array(found)), open_tokens], ["near", "open"])

    return near


def _out_of_head(ids: pa.Array, head: pa.Array, size: int, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids, those that are none as the unknown one's, and the places of those that the head lacks."""
    flat = pc.fill_null(ids.flatten(), unknown).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.where((flat < 0) | (flat >= size), unknown, flat)
    lacks = np.append(head.is_null().to_numpy(zero_copy_only=False), True)
    return flat, np.flatnonzero(lacks[np.minimum(flat, len(head))])


def _head_decoder(vocabulary: Vocabulary, shared):
    """Arrow UDFs ``ids -> open``, the row's different ids that the head lacks, and ``(ids, found) -> tokens``
    with the tokens of those."""
    size, unknown = vocabulary.size, vocabulary.reserved_id(UNKNOWN)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def open_ids(ids: pa.Array) -> pa.Array:
        flat, missed = _out_of_head(ids, shared.value, size, unknown)
        values, lengths, _ = _open_ones(_rows_of(ids)[missed], flat[missed], len(ids))
        return _lists(pa.array(values, pa.int32()), lengths)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def decoded(ids: pa.Array, found: pa.Array) -> pa.Array:
        head = shared.value
        flat, missed = _out_of_head(ids, head, size, unknown)
        rows = _rows_of(ids)[missed]
        _, _, place = _open_ones(rows, flat[missed], len(ids))
        n_found = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(n_found) - n_found
        flat[missed] = len(head) + starts[rows] + place
        return _mapped(ids, pa.concat_arrays([head, found.flatten().cast(pa.string())]).take(pa.array(flat)))

    return open_ids, decoded


def _joined_lookup(df: DataFrame, columns: Mapping[str, str], vocabulary: Vocabulary, encoding: bool) -> DataFrame:
    """Map the elements of array columns through the vocabulary by joining, for one of any size.

    Frequent tokens are the hot join keys, and they have the lowest ids. So the head of the
    vocabulary, of bounded size, is broadcast and looked up in place, and a row sends only the different
    tokens that the head lacks to the rest. What is found comes back to the row as one short list a column.
    Rows are written once, with a number of their own to come together by, unless they were written with one
    (``__row``) before; so their tokens are worked out once, and rows of equal keys stay apart.
    """
    from_col, to_col = ("token", "token_id") if encoding else ("token_id", "token")
    first = F.col("token_id") < HEAD_TOKENS
    short = F.octet_length("token") <= HEAD_TOKEN_BYTES
    mark, shared = _head(vocabulary, vocabulary.table.filter(first).select("token_id", F.when(short, F.col("token")).alias("token")))
    rest = vocabulary.table.filter(~(first & short)).select(from_col, to_col)
    kept = df.columns
    numbered = "__row" in kept
    base = df if numbered else df.withColumn("__row", F.monotonically_increasing_id())
    if encoding:
        near = _head_encoder(vocabulary, mark, shared)
        base = base.withColumns({f"__near_{i}": near(F.col(column)) for i, column in enumerate(columns)})
        open_ones = [F.col(f"__near_{i}.open") for i in range(len(columns))]
    else:
        open_ids, decoded = _head_decoder(vocabulary, shared)
        base = base.withColumns({f"__near_{i}": open_ids(F.col(column)) for i, column in enumerate(columns)})
        open_ones = [F.col(f"__near_{i}") for i in range(len(columns))]
    if not numbered:
        base = write_scratch(base, "looked-up")

    def listed(side: int, ones: Column) -> Column:
        return F.transform(ones, lambda x, at: F.struct(F.lit(side).alias("side"), at.alias("at"), x.alias(from_col)))

    def filled(near: str, found: str) -> Column:
        return F.transform(near, lambda x: F.when(x < 0, F.get(found, -1 - x)).otherwise(x))

    entries = base.select("__row", F.explode(F.concat(*[listed(i, ones) for i, ones in enumerate(open_ones)])).alias("e")).select("__row", "e.*")
    default = F.lit(vocabulary.reserved_id(UNKNOWN)) if encoding else F.lit(UNKNOWN)
    found = entries.join(rest, from_col, "left").groupBy("__row").agg(
        *[ar.in_order(F.when(F.col("side") == i, F.col("at")), F.coalesce(F.col(to_col), default)).alias(f"__found_{i}") for i in range(len(columns))]
    )
    together = attach(base, found, ["__row"])
    for i, (column, name) in enumerate(columns.items()):
        value = filled(f"__near_{i}.near", f"__found_{i}") if encoding else decoded(F.col(column), F.col(f"__found_{i}"))
        together = together.withColumn(name, value)
    return together.select(*dict.fromkeys([*kept, *columns.values()]))
