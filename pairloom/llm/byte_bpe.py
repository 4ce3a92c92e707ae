"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding.

Text is cut where the pattern of the rank files cuts it, but without a regular expression:

1. Every code point of a chunk of texts gets a symbol: its class (letter, number, other, white
   space) with one step of look-ahead where the pattern looks ahead.
2. A symbol is a function from tokenizer state to tokenizer state. Functions compose
   associatively, so blocks of text are folded independently, block results are combined by a
   doubling scan, and every block is then replayed from its true entry state. All steps work on
   arrays over all blocks at once.
3. A table over (state, symbol) says where a piece begins.

Each distinct piece is merged once per worker and remembered; ids of a chunk are gathered from
the remembered pieces.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import chunks, texts
from pairloom.scratch import write_scratch
from pairloom.session import ship_package

# ---------------------------------------------------------------- where pieces begin

LETTER, NUMBER, OTHER, SHORT_CUT, LONG_CUT, SPACE_END, BLANK_END, SPACE, BLANK, BREAK = range(10)
# SHORT_CUT, LONG_CUT: an apostrophe with a contraction of one or two letters behind it.
# SPACE_END, BLANK_END: U+0020, or other white space, right before something visible.
# SPACE, BLANK: the same before white space or the end. BREAK: between two texts.
_OPEN, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _IN_BLANKS, _AFTER_SPACE, _ONE_MORE, _TWO_MORE = range(8)

# The code points of Unicode's White_Space property.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# The contractions of the pattern, without their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece begins, by symbol * 8 + state."""
    to, begins = np.zeros((10, 8), np.uint8), np.ones((10, 8), bool)
    for symbol, own in ((LETTER, _IN_LETTERS), (NUMBER, _IN_NUMBERS), (OTHER, _IN_OTHERS)):
        to[symbol] = own
        begins[symbol, [own, _AFTER_SPACE]] = False
    to[LETTER, [_ONE_MORE, _TWO_MORE]] = _OPEN, _ONE_MORE
    begins[LETTER, [_ONE_MORE, _TWO_MORE]] = False
    for symbol, then in ((SHORT_CUT, _ONE_MORE), (LONG_CUT, _TWO_MORE)):
        to[symbol] = then
        to[symbol, [_IN_OTHERS, _AFTER_SPACE]] = _IN_OTHERS
        begins[symbol, [_IN_OTHERS, _AFTER_SPACE]] = False
    to[SPACE_END], to[BLANK_END], to[BREAK] = _AFTER_SPACE, _OPEN, _OPEN
    for symbol in (SPACE, BLANK):
        to[symbol] = _IN_BLANKS
        begins[symbol, _IN_BLANKS] = False
    return to.ravel(), begins.ravel()


_TO, _BEGINS = _automaton()
_BLOCK = 256


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in (*range(0x40000), *range(0xE0000, 0xF0000)):  # all other planes are unassigned or private
        first = unicodedata.category(chr(code))[0]
        if first == "L":
            kinds[code] = LETTER
        elif first == "N":
            kinds[code] = NUMBER
    kinds[list(WHITE_SPACE)] = BLANK
    return kinds


def symbols(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``breaks`` are the positions between texts."""
    kinds = code_classes()[codes]
    kinds[breaks] = BREAK
    out = kinds.copy()
    following = np.append(kinds[1:], BREAK)
    blank, space = kinds == BLANK, codes == 0x20
    space &= blank
    ends = blank & (following < BLANK) & (following != BREAK)
    out[space] = SPACE
    out[ends] = BLANK_END
    out[ends & space] = SPACE_END
    for at in np.flatnonzero((codes == 0x27) & (kinds == OTHER)):
        near = "".join(map(chr, codes[at + 1 : at + 3]))
        if kinds[at + 1 : at + 2].tolist() != [LETTER]:
            continue
        if near[0] in CONTRACTIONS:
            out[at] = SHORT_CUT
        elif near in CONTRACTIONS and kinds[at + 2] == LETTER:
            out[at] = LONG_CUT
    return out


def piece_starts(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point; break positions count as pieces of their own."""
    n = len(codes)
    blocks = max(1, -(-n // _BLOCK))
    padded = np.full(blocks * _BLOCK, BREAK, np.uint8)
    padded[:n] = symbols(codes, breaks)
    steps = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T).astype(np.intp) << 3
    # Fold each block to one function: fold[b, s] is the state after block b from state s.
    fold = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in steps:
        fold = _TO[row[:, None] + fold]
    # Doubling scan over blocks; afterwards fold[b] leads from the start to the end of block b.
    reach = 1
    while reach < blocks:
        fold[reach:] = np.take_along_axis(fold[reach:], fold[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.full(blocks, _OPEN, np.uint8)
    state[1:] = fold[:-1, _OPEN]
    begins = np.empty((_BLOCK, blocks), bool)
    for j, row in enumerate(steps):
        at = row + state
        begins[j] = _BEGINS[at]
        state = _TO[at]
    return begins.T.ravel()[:n]


# ---------------------------------------------------------------- merging


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: adjacent parts of lowest joint rank are joined first, leftmost first.

    A heap over a linked list, so that a piece of n bytes takes n log n steps.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that begins here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        middle = end[i]
        if not alive[i] or middle >= n or end[middle] != j or not alive[middle]:
            continue
        alive[middle] = False
        end[i] = j
        if j < n:
            before[j] = i
            if (rank := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))
        if (h := before[i]) >= 0 and (rank := ranks.get(piece[h:j])) is not None:
            heapq.heappush(heap, (rank, h, j))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Merger:
    """Merges many pieces at once. Each round joins, in every piece, the adjacent parts of lowest joint
    rank, leftmost first; joint ranks are looked up for the changed neighbours only."""

    LONGEST = 64  # longer pieces are merged one by one, in n log n steps
    NONE = 1 << 40  # rank of parts that do not join

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int64)
        joined = [
            (left << 32 | right, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        ]
        table = np.array(sorted(joined) or [(-1, 0)], np.int64)
        self.pairs, self.joint = table[:, 0].copy(), table[:, 1].copy()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.joint[at], self.NONE)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of ids of each."""
        out: list = [None] * len(pieces)
        batch = []
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = (whole,)
            elif len(piece) > self.LONGEST:
                out[i] = merge(piece, self.ranks)
            else:
                batch.append(i)
        if batch:
            ids, counts = self._merge_short([pieces[i] for i in batch])
            ends = np.cumsum(counts)
            for i, begin, end in zip(batch, (ends - counts).tolist(), ends.tolist()):
                out[i] = ids[begin:end]
        counts = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.concatenate([np.asarray(x, np.int64) for x in out]) if out else np.zeros(0, np.int64)
        return flat, counts

    def _merge_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        if (ids < 0).any():
            raise ValueError("the ranks lack a single byte")
        own = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        done_ids, done_own = [], []
        rank = np.full(len(ids), self.NONE)
        rank[:-1] = np.where(own[1:] == own[:-1], self._ranks(ids[:-1], ids[1:]), self.NONE)
        while len(ids):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sizes = np.diff(np.append(first, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, first), sizes)
            live = best < self.NONE
            if not live.all():  # pieces that are finished leave
                done_ids.append(ids[~live])
                done_own.append(own[~live])
                ids, own, rank, best = ids[live], own[live], rank[live], best[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.append(True, own[at[1:]] != own[at[:-1]])]  # the leftmost of each piece
            ids[at] = rank[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))  # one part has gone from each piece before
            ids, own, rank = ids[stay], own[stay], rank[stay]
            for left in (at, at - 1):
                left = left[(left >= 0) & (left < len(ids) - 1)]
                rank[left] = np.where(own[left] == own[left + 1], self._ranks(ids[left], ids[left + 1]), self.NONE)
            rank[-1] = self.NONE
        ids, own = np.concatenate(done_ids), np.concatenate(done_own)
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(pieces))


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, dtype: type):
        self.held, self.size = np.zeros(1 << 12, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.held):
            self.held = np.concatenate((self.held[: self.size], np.zeros(max(end, 2 * self.size) - self.size, self.held.dtype)))
        self.held[self.size : end] = values
        self.size = end


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``first, first + 1, ...``, ``count`` of them, for each pair, end to end."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


class TokenBytes:
    """The tokens' bytes end to end, for decoding by gathering."""

    def __init__(self, ranks: dict[bytes, int]):
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int32)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.data = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)) or b"\0", np.uint8)
        self.start = np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids one after the other."""
        return self.data[ranges(self.start[ids], self.lengths[ids].astype(np.int64))]


class PieceCache(dict):
    """Piece to its place in flat arrays of ids. Two generations: a full one becomes the elder, whose
    pieces come over as they are met again, and the eldest go."""

    MOST_PIECES, LONGEST = 300_000, 512

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.merger = Merger(ranks)
        tokens = TokenBytes(ranks)
        self.lengths, self.bytes_of = tokens.lengths, tokens.of
        self.begin()

    def begin(self) -> None:
        self._begin()
        self.elder = ({}, self.ids, self.first, self.count)

    def _begin(self) -> None:
        self.clear()
        self.ids, self.first, self.count = _Grown(np.int32), _Grown(np.int64), _Grown(np.int64)
        self.fresh: list[bytes] = []  # pieces that have a place, but no ids yet

    def turn(self) -> None:
        """Begin a new generation if this one is full. Called between chunks."""
        if len(self) > self.MOST_PIECES or self.ids.size > 16 * self.MOST_PIECES:
            self.elder = (dict(self), self.ids, self.first, self.count)
            self._begin()

    def __missing__(self, piece: bytes) -> int:
        place = self.first.size + len(self.fresh)
        self.fresh.append(piece)
        if len(piece) <= self.LONGEST:
            self[piece] = place
        return place

    def find(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are not known, end to end, and their number for each."""
        return self.merger.merge_all(pieces)

    def settle(self) -> None:
        """Find the ids of the pieces met, from the elder generation or by merging."""
        if not self.fresh:
            return
        places, ids, first, count = self.elder
        known = np.fromiter((places.get(p, -1) for p in self.fresh), np.int64, len(self.fresh))
        old = np.flatnonzero(known >= 0)
        new = np.flatnonzero(known < 0)
        merged, sizes = self.find([self.fresh[i] for i in new.tolist()])
        counts = np.zeros(len(known), np.int64)
        counts[old], counts[new] = count.held[known[old]], sizes
        begin = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        flat[ranges(begin[old], counts[old])] = ids.held[ranges(first.held[known[old]], counts[old])]
        flat[ranges(begin[new], counts[new])] = merged
        self.first.extend(begin + self.ids.size)
        self.count.extend(counts)
        self.ids.extend(flat)
        self.fresh = []


def encode_texts(values: list[str], cache: PieceCache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, byte offset of each id in its text, ids per text."""
    cache.turn()
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    joined = "\0".join(values)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    breaks = np.cumsum(lengths + 1)[:-1] - 1
    starts = np.flatnonzero(piece_starts(codes, breaks))
    width = np.ones(len(codes), np.int64)
    for limit in (0x80, 0x800, 0x10000):
        width += codes >= limit
    offset = np.concatenate(([0], np.cumsum(width)))
    data = joined.encode()
    begin = offset[starts]
    end = np.append(begin[1:], offset[-1])
    real = np.ones(len(starts), bool)
    real[np.searchsorted(starts, breaks)] = False  # the breaks themselves
    begin, end, starts = begin[real], end[real], starts[real]
    places = np.fromiter(
        map(cache.__getitem__, map(data.__getitem__, map(slice, begin.tolist(), end.tolist()))), np.int64, len(begin)
    )
    cache.settle()
    count, first = cache.count.held[places], cache.first.held[places]
    ids = cache.ids.held[ranges(first, count)]
    n = len(ids)
    owner = np.searchsorted(breaks, starts, side="right")  # the text of each piece
    per_text = np.bincount(owner, weights=count, minlength=len(values)).astype(np.int64)
    # A token begins where the lengths of the tokens before it in its text end.
    sizes = cache.lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    text_first = np.cumsum(per_text) - per_text
    base = np.repeat(np.where(per_text > 0, (ends - sizes)[np.minimum(text_first, max(n - 1, 0))] if n else 0, 0), per_text)
    return ids, (ends - sizes - base).astype(np.int32), per_text


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


_kept: dict[str, PieceCache] = {}


def _worker_cache(mark: str, ranks: Broadcast) -> PieceCache:
    """The worker's cache for the ranks of this mark; that of other ranks is let go."""
    if mark not in _kept:
        _kept.clear()
        _kept[mark] = PieceCache(ranks.value)
    return _kept[mark]


# ---------------------------------------------------------------- operators


def encode(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids`` and ``offsets`` (both array<int>).

    ``offsets`` holds the byte at which each id begins in the text's UTF-8 form. A null text is
    an empty one; an empty text has empty arrays. Repeated rows stay repeated. A column of
    ``docs`` named ``ids`` or ``offsets`` is replaced. The rank file is read on the driver and
    broadcast: its size is the vocabulary's and does not grow with the data.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranks, mark = spark.sparkContext.broadcast(read_ranks(ranks_path)), ranks_path
    kept = [f for f in docs.schema.fields if f.name not in (text, "ids", "offsets")]
    out = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _worker_cache(mark, ranks)
        for batch in batches:
            for rows, values in chunks(batch, text):
                ids, offsets, counts = encode_texts(values, cache)
                columns = [rows.column(f.name) for f in kept] + [_lists(ids, counts), _lists(offsets, counts)]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "ids", "offsets"])

    return texts(docs, *(f"`{f.name}`" for f in kept), f"`{text}`").mapInArrow(run, out)


def _bytes(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values, ``counts`` bytes each, of bytes that lie end to end."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids as a binary column; null ids give no bytes. An id that the
    ranks do not have fails."""
    spark = encoded.sparkSession
    ship_package(spark)
    # Only the bytes are sent: a worker that decodes needs no ranks and no cache of pieces.
    shared = spark.sparkContext.broadcast(TokenBytes(read_ranks(ranks_path)))
    kept = [f for f in encoded.schema.fields if f.name != name]
    out = T.StructType([*kept, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            for rows, values, counts in _id_chunks(batch, ids):
                if len(values) and not (0 <= values.min() and values.max() < len(tokens.lengths)):
                    raise ValueError("an id that the ranks do not have")
                ends = np.concatenate(([0], np.cumsum(tokens.lengths[values], dtype=np.int64)))
                per_row = np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])
                decoded = _bytes(tokens.of(values), per_row)
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), decoded], [*(f.name for f in kept), name])

    return encoded.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, out)


CHUNK_IDS = 1 << 18  # ids that are decoded at a time; a row of more is a chunk of its own


def _id_chunks(batch: pa.RecordBatch, ids: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of a batch with the ids in them and their number per row, null as none."""
    sizes = batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate([*sizes.tolist(), None]):
        if size is None or (i > begin and held + size > CHUNK_IDS):
            rows = batch.slice(begin, i - begin)
            yield rows, rows.column(ids).flatten().to_numpy(zero_copy_only=False), sizes[begin:i]
            begin, held = i, 0
        held += size or 0


def token_digests(docs: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """Per document: key, number of ids, digest of the ids, digest of the bytes decoded from them.

    Ids are written in between. In one stage a task would have a Python worker for either step, and as the
    workers take turns, each of them would come to hold a cache of pieces.
    """
    encoded = write_scratch(encode(docs.select(key, "text"), ranks_path).drop("offsets"), "ids")
    return decode(encoded, ranks_path).select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
