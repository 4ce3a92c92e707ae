"""Packing token sequences into as few fixed-length ones as possible, by a grouping genetic algorithm.

Documents are tokenized, ended by an end id, and only cut where one is longer than a sequence. What is
left to decide is which pieces share a sequence (a bin).

1. Pieces are dealt over islands of about ``ISLAND`` pieces. Each island breeds a small population
   of packings of its own pieces. A gene is a whole bin.
2. Crossover takes well-filled bins of one parent as they are into the other. Bins there that share a piece
   with them go; the pieces that lose their bin this way are best-fitted, longest first, into what is left, or
   into new bins. An offspring replaces the worst of its island if it is fitter: fewer bins, then more
   of the space in nearly full bins (the mean square of the filling).
3. Islands hold different pieces, but pieces of one length are alike. So what migrates are patterns:
   the lengths of completely filled bins. The most frequent patterns of all islands, a bounded number, go to
   every island, which fills them with its own pieces and takes them in by the same crossover.
4. Pieces of badly filled bins of all islands are pooled and packed again on fewer islands, until one is
   left or nothing is won, so that no island keeps a rest of its own.

An island whose packing has as few bins as its tokens need is done; breeding ends there.
"""

from __future__ import annotations

import json
import random
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.byte_bpe import PieceCache, ranges
from pairloom.llm.common import chunks, texts
from pairloom.scratch import write_scratch
from pairloom.session import ship_package

CAPACITY, END_ID = 2048, 0
ISLAND = 4_000  # pieces of an island, about
POPULATION, GENERATIONS = 5, 12  # packings of an island, and offspring between two migrations, each
INJECTED = 0.3  # share of a parent's bins that a crossover takes over, best first
MIGRANTS = 256  # patterns that are sent to all islands
LONGEST_PATTERN = 64  # pieces of a pattern, at most
GOOD = 0.995  # filling from which on a bin stays closed when rests are pooled

Packing = list[list[int]]  # bins of piece numbers

# ---------------------------------------------------------------- breeding


def best_fit(order: list[int], sizes: list[int], bins: Packing, capacity: int) -> Packing:
    """``bins`` with the pieces of ``order`` put in one by one, each where it leaves the least room."""
    bins = [list(b) for b in bins]
    room = sorted((capacity - sum(sizes[i] for i in b), at) for at, b in enumerate(bins))
    room = [r for r in room if r[0] > 0]
    for i in order:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, place = room.pop(at)
            bins[place].append(i)
        else:
            left, place = capacity, len(bins)
            bins.append([i])
        if left > size:
            insort(room, (left - size, place))
    return bins


def fitness(packing: Packing, sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: larger is better."""
    fill = [sum(sizes[i] for i in b) / capacity for b in packing]
    return -len(packing), sum(x * x for x in fill) / max(1, len(fill))


def inject(parent: Packing, bins: Packing, sizes: list[int], capacity: int) -> Packing:
    """``parent`` with whole ``bins`` taken in: its bins that share a piece with them go, and the pieces
    that are then without a bin are best-fitted, longest first."""
    taken = {i for b in bins for i in b}
    kept, displaced = [], []
    for b in parent:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in taken]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, [*bins, *kept], capacity)


def filled_patterns(patterns: list[list[int]], sizes: list[int], dice: random.Random) -> Packing:
    """Bins of these patterns made of own pieces, each piece once; patterns that cannot be filled are left out."""
    stock: dict[int, list[int]] = defaultdict(list)
    for i, size in enumerate(sizes):
        stock[size].append(i)
    out = []
    for pattern in dice.sample(patterns, len(patterns)):
        chosen = []
        for size in pattern:
            if not stock[size]:
                break
            chosen.append(stock[size].pop())
        if len(chosen) == len(pattern):
            out.append(chosen)
        else:
            for i in chosen:
                stock[sizes[i]].append(i)
    return out


def breed(sizes: list[int], capacity: int, seed: int, start: Packing | None = None, patterns: list[list[int]] = ()) -> Packing:
    """The best packing of an island; the same for the same arguments. ``start`` is one to go on from."""
    needed = -(-sum(sizes) // capacity)
    longest = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    best = start if start is not None else best_fit(longest, sizes, [], capacity)
    if len(best) <= needed:
        return best
    dice = random.Random(seed)
    rank = lambda p: fitness(p, sizes, capacity)
    population = [(rank(best), best)]
    if patterns:
        offspring = inject(best, filled_patterns(patterns, sizes, dice), sizes, capacity)
        population.append((rank(offspring), offspring))
    while len(population) < POPULATION:
        spread = {i: sizes[i] * dice.uniform(0.7, 1.3) for i in longest}
        other = best_fit(sorted(longest, key=lambda i: -spread[i]), sizes, [], capacity)
        population.append((rank(other), other))
    for _ in range(GENERATIONS):
        population.sort(key=lambda x: x[0], reverse=True)
        if -population[0][0][0] <= needed:
            break
        # The giver's fullest bins go to a receiver; the better of two is drawn for either.
        draw = lambda: population[min(dice.randrange(len(population)), dice.randrange(len(population)))][1]
        giver, receiver = draw(), draw()
        if giver is receiver:
            receiver = population[-1][1] if giver is not population[-1][1] else population[0][1]
        fullest = sorted(giver, key=lambda b: (-sum(sizes[i] for i in b), dice.random()))
        chosen = fullest[: max(1, int(len(fullest) * dice.uniform(INJECTED / 2, INJECTED * 2)))]
        offspring = inject(receiver, chosen, sizes, capacity)
        scored = (rank(offspring), offspring)
        if scored[0] > population[-1][0]:
            population[-1] = scored
    return max(population, key=lambda x: x[0])[1]


# ---------------------------------------------------------------- pieces

_PIECE = "piece int, start long, length long, ids_crc32 long"
# Python counts these as white space, the tokenizer does not.
_NO_BLANKS = ("\x1c", "\x1d", "\x1e", "\x1f")


# The normalizer and the pattern of tokenizers for which ``parted`` holds.
LOWER_CASE = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _parts_like_this(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, drops white space and cuts where ``parted`` does."""
    made = json.loads(tokenizer.to_str())
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (made.get("normalizer") or {}).get("normalizers", [])]
    first = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    split = first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
    return steps == LOWER_CASE and split and all(t["special"] for t in made["added_tokens"])


WORD_END = "</w>"  # fixed value: how the vocabulary marks the last token of a word
BLOCK_WORDS = 4_000


def _plain(word: str) -> int:
    """Words that the tokenizer takes a plain word for: Latin-1 letters are one, with a mark behind them two; else 0."""
    body = word[:-1] if word and word[-1] in ".,;:!?" else word
    return 1 + (len(body) < len(word)) if body.isalpha() and max(body) <= "\xff" else 0


def _latin_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and class of the Latin-1 characters; the last entry stands for all others."""
    chars = [chr(c) for c in range(256)]
    lower = np.array([ord(c.lower()) for c in chars] + [0], np.uint32)
    kinds = [_LETTER if c.isalpha() else _NUMBER if unicodedata.category(c)[0] == "N" else _BLANK if c.isspace() else _MARK for c in chars]
    kinds[ord("'")] = _QUOTE
    return lower, np.array([*kinds, _FOREIGN], np.uint8)


_LETTER, _NUMBER, _MARK, _QUOTE, _BLANK, _FOREIGN = range(6)
_LOWER, _KIND = _latin_tables()
# Classes side by side that no piece of the pattern holds; a quote may begin a contraction, but never follows a letter in one.
_PARTED = np.zeros((6, 6), bool)
_PARTED[_LETTER, [_NUMBER, _MARK, _QUOTE]] = True
_PARTED[_NUMBER, [_LETTER, _NUMBER, _MARK, _QUOTE]] = True
_PARTED[_MARK, [_LETTER, _NUMBER]] = True
_PARTED[_QUOTE, _NUMBER] = True


def parted(values: list[str]) -> list[str]:
    """The texts with Latin-1 letters in lower case and a blank wherever the pattern parts two Latin-1
    characters in any text, so that a word is the same with and without marks around it.

    Next to other characters nothing changes: what the tokenizer makes of them, the library decides.
    """
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    codes = np.frombuffer("\n".join(values).encode("utf-32-le"), np.uint32)
    if not len(codes):
        return values
    latin = np.minimum(codes, 256)
    kinds = _KIND[latin]
    keep = latin == 256
    keep[:-1] |= keep[1:]  # a combining mark may follow
    codes = np.where(keep, codes, _LOWER[latin])
    cuts = np.flatnonzero(_PARTED.ravel()[kinds[:-1] * 6 + kinds[1:]]) + 1
    joined = np.insert(codes, cuts, 0x20).tobytes().decode("utf-32-le")
    begin = np.cumsum(lengths + 1) - lengths - 1
    end = begin + lengths
    begin, end = begin + np.searchsorted(cuts, begin, "right"), end + np.searchsorted(cuts, end)
    return [joined[a:b] for a, b in zip(begin.tolist(), end.tolist())]


class WordIds(PieceCache):
    """Ids of white-space separated words, as the tokenizer gives them; each different word is tokenized once.

    For tokenizers that drop white space and never join what it parts. Two generations bound it.
    """

    def __init__(self, tokenizer):
        dict.__init__(self)
        self.tokenizer = tokenizer
        names = {i: name for name, i in tokenizer.get_vocab().items()}
        self.ends_word = np.array([names.get(i, "").endswith(WORD_END) for i in range(max(names) + 1)])
        # Another tokenizer may tell upper case, or join marks to words: its words stay as they are.
        self.cut = parted if _parts_like_this(tokenizer) else list
        self.begin()

    def find(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Plain words are tokenized a block at a time as one text; the ids that end a word tell them apart.
        parts = [_plain(w) for w in pieces]
        plain, found = [i for i, n in enumerate(parts) if n], {}
        for begin in range(0, len(plain), BLOCK_WORDS):
            block = plain[begin : begin + BLOCK_WORDS]
            ids = np.array(self._encode([" ".join(pieces[i] for i in block)])[0], np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            last = np.cumsum([parts[i] for i in block])
            if len(ends) == last[-1]:
                cuts = ends[last - 1].tolist()
                found.update((i, ids[a:b]) for i, a, b in zip(block, [0, *cuts], cuts))
        rest = [i for i in range(len(pieces)) if i not in found]
        found.update(zip(rest, self._encode([pieces[i] for i in rest])))
        every = [found[i] for i in range(len(pieces))]
        return np.concatenate([np.asarray(x, np.int64) for x in every]), np.fromiter(map(len, every), np.int64, len(every))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_texts(self, values: list[str], end_id: int) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        self.turn()
        odd = [any(c in v for c in _NO_BLANKS) for v in values]
        words = [[v] if whole else cut.split() for v, whole, cut in zip(values, odd, self.cut(values))]
        places = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        self.settle()
        count = self.count.held[places]
        ids = self.ids.held[ranges(self.first.held[places], count)]
        ends = np.concatenate(([0], np.cumsum(count)))[np.cumsum([len(w) for w in words])]
        return np.split(np.insert(ids, ends, end_id).astype("<u4"), ends[:-1] + np.arange(1, len(values)))


_kept: dict[int, WordIds] = {}


def _worker_ids(definition: str) -> WordIds:
    """The worker's words of this tokenizer; those of another are let go."""
    import os

    from tokenizers import Tokenizer

    mark = hash(definition)
    if mark not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = Tokenizer.from_str(definition)
        tokenizer.encode_special_tokens = True
        _kept.clear()
        _kept[mark] = WordIds(tokenizer)
    return _kept[mark]


def pieces(
    docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """``docs`` without its text, one row per piece: ``piece`` (from 0), ``start`` (ids before it), ``length``,
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit numbers) and, if asked for, ``ids``.

    Strings of special tokens in a text are ordinary text. A null text is an empty one and has one
    piece, the end id. The tokenizer's file is read on the driver and sent to the workers. It must be one
    that drops white space and never joins what it parts: each different word is tokenized once by a worker.
    """
    ship_package(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    kept = [c for c in docs.columns if c not in (text, "piece", "start", "length", "ids_crc32", "ids")]
    rows = texts(docs, F.struct(*(F.col(f"`{c}`") for c in kept)).alias("rest"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _worker_ids(shared.value)
        for batch in batches:
            for part, values in chunks(batch, "text"):
                owner, number, start, length, crc, ids = [], [], [], [], [], []
                for row, data in enumerate(known.of_texts(values, end_id)):
                    for k, begin in enumerate(range(0, len(data), capacity)):
                        cut = data[begin : begin + capacity]
                        owner.append(row)
                        number.append(k)
                        start.append(begin)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        if with_ids:
                            ids.append(cut.astype(np.int32))
                columns = [part.column("rest").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                names = ["rest", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"rest {kind}, {_PIECE}" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(run, schema).select("rest.*", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))


# ---------------------------------------------------------------- islands on Spark


def _packing_of(bins: np.ndarray) -> Packing:
    held: dict[int, list[int]] = defaultdict(list)
    for i, b in enumerate(bins.tolist()):
        held[b].append(i)
    return list(held.values())


def _breed_islands(capacity: int, patterns: list[list[int]]):
    """Rows of an island with their bin; a bin that is set already is where breeding goes on."""

    def run(island: pa.Table) -> pa.Table:
        island = island.sort_by([("length", "descending"), ("rid", "ascending")])  # the same whatever order rows come in
        sizes = island.column("length").to_pylist()
        bins = island.column("bin").combine_chunks()
        start = None if bins.null_count else _packing_of(bins.to_numpy(zero_copy_only=False))
        number = island.column("island")[0].as_py()
        packing = breed(sizes, capacity, number, start, patterns)
        bin_, fill, offset = (np.zeros(len(sizes), np.int64) for _ in range(3))
        for at, b in enumerate(packing):
            ends = np.cumsum([sizes[i] for i in b])
            bin_[b], fill[b] = number << 24 | at, ends[-1]
            offset[b] = ends - [sizes[i] for i in b]
        out = island.select(["rid", "length", "island"])
        for name, values in (("bin", bin_), ("fill", fill), ("offset", offset)):
            out = out.append_column(name, pa.array(values))
        return out

    return run


_ISLAND = "rid long, length long, island long, bin long, fill long, offset long"


def _evolve(items: DataFrame, capacity: int, patterns: list[list[int]]) -> DataFrame:
    items = items.select("rid", "length", "island", "bin")
    return write_scratch(items.groupBy("island").applyInArrow(_breed_islands(capacity, patterns), _ISLAND), "islands")


def _migrants(items: DataFrame, capacity: int) -> list[list[int]]:
    """The patterns of full bins that most islands' bins have, at most ``MIGRANTS``."""
    full = items.filter(F.col("fill") == capacity).groupBy("bin").agg(F.sort_array(F.collect_list("length"), asc=False).alias("pattern"))
    common = full.filter((F.size("pattern") > 1) & (F.size("pattern") <= LONGEST_PATTERN)).groupBy("pattern").agg(F.count("*").alias("n"))
    return [r["pattern"] for r in common.orderBy(F.col("n").desc(), "pattern").limit(MIGRANTS).collect()]


def _dealt(items: DataFrame, n_islands: int, first: int) -> DataFrame:
    island = F.pmod(F.xxhash64("rid"), F.lit(n_islands)) + F.lit(first).cast("long")
    return items.select("rid", "length", island.alias("island"), F.lit(None).cast("long").alias("bin"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: the bin a piece is in, and the tokens before it there.

    Needs a column ``length`` from 1 to ``capacity``. Bins are gapless. A piece that fills a bin has one of
    its own. Repeated rows are pieces of their own. Any other columns come along; of columns named
    ``sequence_id`` or ``offset`` the old ones go. No pieces give no rows.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    pieces = pieces.drop("sequence_id", "offset")
    # Row numbers of their own, written with the rows, so that copies are dealt apart.
    stored = write_scratch(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    whole = stored.filter(F.col("length") >= capacity).select(
        *pieces.columns, (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = stored.filter(F.col("length") < capacity).select("rid", F.col("length").cast("long").alias("length"))
    n, first, done = rest.count(), 0, None
    pool = _dealt(rest, max(1, -(-n // ISLAND)), 0)
    while n:
        n_islands = max(1, -(-n // ISLAND))
        items = _evolve(pool, capacity, [])
        if n_islands > 1 and (patterns := _migrants(items, capacity)):
            items = _evolve(items, capacity, patterns)
        first += n_islands
        if n_islands == 1:
            done = items if done is None else done.unionByName(items)
            break
        closed = items.filter(F.col("fill") >= GOOD * capacity)
        done = closed if done is None else done.unionByName(closed)
        open_ = items.filter(F.col("fill") < GOOD * capacity)
        before, n = n, open_.count()
        if n > 0.9 * before:  # hardly anything closes: pooling again wins nothing
            done = done.unionByName(open_)
            break
        pool = _dealt(open_.select("rid", "length"), max(1, -(-n // ISLAND)), first)
    if done is None:
        return whole
    places = done.select("rid", F.col("bin").alias("sequence_id"), "offset")
    packed = stored.filter(F.col("length") < capacity).join(places, "rid").select(*pieces.columns, "sequence_id", "offset")
    return packed.unionByName(whole)


def packing_digests(docs: DataFrame, tokenizer_path: str, key: str = "doc_id") -> DataFrame:
    """Per piece: key, place in its document, digest of its ids, and place in its sequence."""
    return pack(pieces(docs.select(key, "text"), tokenizer_path))
