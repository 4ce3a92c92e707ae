"""Spelling variants of words, found in a trie of letter counts.

Two words are *near* if one inserted, deleted or replaced letter makes one of the other. Such words
have nearly the same letters: a replaced letter leaves one letter group with one more and one with one
less, an inserted letter leaves one group with one more, and nothing else differs. So:

1. Every word has a vector of counts, one per letter group (``ORDER``), and words are arranged in a trie
   by successive counts.
2. A depth-first search takes a word's own vector down the trie with a budget of one surplus and one
   deficit. Pairs are met once: the word that is looked for is the longer one, or of equal length and
   has its surplus first. The search carries many words at a time; what grows beyond ``FRONTIER`` is
   put on the stack in halves.
3. Words at the leaves are verified letter by letter.

Spark holds the trie's top: cells are the subtrees under the first few counts. A word goes to its own
cell as an entry, and to each cell that its budget lets it reach as a question. The number of counts that
make a cell is raised until the largest cell has ``CELL`` words, so that no task grows with the
vocabulary; words with all counts alike are the least cell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import texts
from pairloom.scratch import write_scratch
from pairloom.session import ship_package

ORDER = "eainrtosldcumpghbfvkyzjwxq"  # the letter groups, most telling first; other letters are dealt over them by code
LEVELS = len(ORDER)
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
NOISE = 31  # of so many occurrences one loses a letter
CELL = 60_000  # words of a cell, about
FRONTIER = 1 << 17  # open places of a search that are carried at a time
QUESTIONS = 1 << 13  # words that are looked for at a time
HELD = 300_000  # distinct words that a task combines before it sends them on
LONG_TEXT = 1 << 22  # letters beyond which a text's words are not listed all at once
BROADCAST_CELLS = 500_000  # cells whose list is broadcast, at most LEVELS bytes each

_GROUP = np.array([ORDER.find(chr(x)) if 0x61 <= x <= 0x7A else x % LEVELS for x in range(256)], np.int64)


def _count_words(least: int, noise: int):
    """Words of each task with their number; letters are bytes of Latin-1 here."""
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            columns = [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                # A character beyond Latin-1 becomes a question mark, which is no letter either.
                data = (text.as_py() or "").encode("latin-1", "replace").lower()
                found = Counter(runs.findall(data) if len(data) <= LONG_TEXT else (m.group() for m in runs.finditer(data)))
                begun = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
            if len(held) > HELD:
                yield emit()
        yield emit()

    return run


# ---------------------------------------------------------------- the trie


class Words:
    """Words laid end to end, with their vectors of letter counts."""

    def __init__(self, words: list[str]):
        self.words = words
        data = [w.encode("latin-1") for w in words]
        self.size = np.fromiter(map(len, data), np.int64, len(data))
        self.begin = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(data), np.uint8)
        own = np.repeat(np.arange(len(words)), self.size)
        counts = np.bincount(own * LEVELS + _GROUP[self.letters], minlength=len(words) * LEVELS)
        self.counts = counts.reshape(len(words), LEVELS)


class Trie:
    """Vectors of counts by successive counts; a leaf holds the words of one vector."""

    def __init__(self, words: Words):
        self.words = words
        order = np.lexsort(words.counts.T[::-1])
        vectors = words.counts[order]
        differs = vectors[1:] != vectors[:-1]
        # The first level at which a vector leaves the one before it; LEVELS if it is the same.
        leaves_at = np.where(differs.any(axis=1), differs.argmax(axis=1), LEVELS) if len(order) > 1 else np.zeros(0, np.int64)
        self.base = int(words.counts.max(initial=0)) + 3  # counts are asked for one above and one below
        self.keys: list[np.ndarray] = []  # per level, of every node: parent and count; sorted
        parent = np.zeros(len(order), np.int64)
        for level in range(LEVELS):
            fresh = np.append(True, leaves_at <= level)[: len(order)]
            self.keys.append(parent[fresh] * self.base + vectors[fresh, level] + 1)
            parent = np.cumsum(fresh) - 1
        first = np.flatnonzero(np.append(True, leaves_at < LEVELS)[: len(order)])
        self.order, self.first = order, first
        self.held = np.diff(np.append(first, len(order)))

    def near(self, asked: Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of asked words and of held words that are near, the held one being the later of the pair."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(asked.words)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int8))] if n and len(self.order) else []
        while stack:
            level, who, node, spent = stack.pop()
            if level == LEVELS:
                found.append(self._verified(asked, who, node, spent))
                continue
            keys, count = self.keys[level], asked.counts[who, level]
            parts = []
            # Nothing spent: equal, or the surplus. Then equal, or the deficit. Then equal.
            for change, allowed in ((0, None), (1, spent == 0), (-1, spent == 1)):
                take = slice(None) if allowed is None else np.flatnonzero(allowed)
                wanted = node[take] * self.base + (count[take] + change + 1)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                parts.append((who[take][hit], at[hit], (spent[take] + (change != 0))[hit]))
            who, node, spent = (np.concatenate(x) for x in zip(*parts))
            if len(who) > FRONTIER:
                half = len(who) // 2
                stack.append((level + 1, who[half:], node[half:], spent[half:]))
                who, node, spent = who[:half], node[:half], spent[:half]
            if len(who):
                stack.append((level + 1, who, node, spent))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))

    def _verified(self, asked: Words, who: np.ndarray, leaf: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words in reached leaves those that are one letter away."""
        count = self.held[leaf]
        who, spent = np.repeat(who, count), np.repeat(spent, count)
        ends = np.cumsum(count)
        other = self.order[np.repeat(self.first[leaf] - ends + count, count) + np.arange(len(who))]
        held = self.words
        begin_a, size_a, begin_b, size_b = asked.begin[who], asked.size[who], held.begin[other], held.size[other]
        front = _common(asked.letters, begin_a, held.letters, begin_b, size_a, 1)
        back = _common(asked.letters, begin_a + size_a - 1, held.letters, begin_b + size_b - 1, size_a, -1)
        # Equal words have all letters in common from the front. One letter more: the rest is the shorter word.
        near = np.where(size_a == size_b, (front + back >= size_a - 1) & (front < size_a), front + back >= size_a)
        # Words of one vector meet from both sides; the letter where they part tells which one asks.
        part = np.minimum(front, size_a - 1)
        near &= (spent > 0) | (asked.letters[begin_a + part] < held.letters[begin_b + part])
        return who[near], other[near]


def _common(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Letters that each two words have in common from two places on, at most ``most``."""
    out, live = np.zeros(len(at_a), np.int64), np.arange(len(at_a))
    k = 0
    while len(live):
        live = live[most[live] > k]
        live = live[a[at_a[live] + k * step] == b[at_b[live] + k * step]]
        out[live] += 1
        k += 1
    return out


# ---------------------------------------------------------------- on Spark

_CLIP = 255


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.minimum(Words(batch.column("word").to_pylist()).counts, _CLIP).astype(np.uint8)
        vectors = [row.tobytes() for row in counts]
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(vectors, pa.binary())], ["word", "n", "vector"])


def reached_cells(counts: np.ndarray, depth: int) -> list[set[bytes]]:
    """For each vector the cells that its budget reaches: the first ``depth`` counts, as bytes."""
    top = counts[:, :depth]
    if top.size and top.max() >= _CLIP - 1:  # clipped counts: cells may coincide
        out = []
        for row in top.tolist():
            cells = set()
            for up in (None, *range(depth)):
                for down in (None, *(range(up + 1, depth) if up is not None else ())):
                    changed = [c + (i == up) - (i == down) for i, c in enumerate(row)]
                    if min(changed) >= 0:
                        cells.add(bytes(min(c, _CLIP) for c in changed))
            out.append(cells)
        return out
    small = top.astype(np.uint8)
    out = [{row.tobytes()} for row in small]
    for up in range(depth):
        raised = small.copy()
        raised[:, up] += 1
        for cells, row in zip(out, raised):
            cells.add(row.tobytes())
    for up, down in combinations(range(depth), 2):
        has = np.flatnonzero(small[:, down])
        moved = small[has]
        moved[:, up] += 1
        moved[:, down] -= 1
        for i, row in zip(has.tolist(), moved):
            out[i].add(row.tobytes())
    return out


def _deal(depth: int):
    """Every word as an entry (role 0) of its cell and a question (role 1) to all cells in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, QUESTIONS):
                part = batch.slice(begin, QUESTIONS)
                words = part.column("word").to_pylist()
                reached = reached_cells(Words(words).counts, depth)
                own = [v[:depth] for v in part.column("vector").to_pylist()]
                count = np.fromiter(map(len, reached), np.int64, len(reached))
                rows = pa.array(np.concatenate((np.arange(len(words)), np.repeat(np.arange(len(words)), count))))
                role = np.concatenate((np.zeros(len(words), np.int8), np.ones(int(count.sum()), np.int8)))
                cells = pa.array(own + [c for cells in reached for c in cells], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [cells, pa.array(role), part.column("word").take(rows), part.column("n").take(rows)], ["cell", "role", "word", "n"]
                )

    return run


def _search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, entries first. Each near pair gives a row to either word."""
    cell, held, counts, trie = None, [], [], None

    def answers(words: list[str], numbers: list[int]) -> pa.RecordBatch:
        a, b = trie.near(Words(words))
        n_a, n_b = np.array(numbers, np.int64)[a], np.array(counts, np.int64)[b]
        name_a, name_b = pa.array(words, pa.string()).take(pa.array(a)), pa.array(held, pa.string()).take(pa.array(b))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([name_a, name_b]), pa.concat_arrays([name_b, name_a]), pa.array(np.concatenate((n_b, n_a)))], ["word", "near", "near_n"]
        )

    for batch in batches:
        names, roles = batch.column("cell").to_pylist(), batch.column("role").to_pylist()
        words, numbers = batch.column("word").to_pylist(), batch.column("n").to_pylist()
        begin = 0
        while begin < len(names):
            end = begin + 1
            while end < len(names) and names[end] == names[begin] and roles[end] == roles[begin] and end - begin < QUESTIONS:
                end += 1
            if names[begin] != cell:
                cell, held, counts, trie = names[begin], [], [], None
            if roles[begin] == 0:
                held += words[begin:end]
                counts += numbers[begin:end]
            elif held:
                if trie is None:
                    trie = Trie(Words(held))
                yield answers(words[begin:end], numbers[begin:end])
            begin = end


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``, both ways, for all near words of a table ``(word, n)`` of different words."""
    ship_package(words.sparkSession)
    known = write_scratch(words.select("word", "n").mapInArrow(_vectors, "word string, n long, vector binary"), "vectors")
    for depth in range(3, LEVELS + 1):
        cells = known.groupBy(F.substring("vector", 1, depth).alias("cell")).agg(F.count("*").alias("words"))
        largest, n_cells = cells.agg(F.max("words"), F.count("*")).first()
        if (largest or 0) <= CELL:
            break
    dealt = known.mapInArrow(_deal(depth), "cell binary, role byte, word string, n long")
    there = cells.select("cell")
    dealt = dealt.join(F.broadcast(there) if n_cells <= BROADCAST_CELLS else there, "cell", "left_semi")
    ordered = dealt.repartition("cell").sortWithinPartitions("cell", "role")
    return ordered.select("cell", "role", "word", "n").mapInArrow(_search_cells, "word string, near string, near_n long")


def _last_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for rows ``(word, form)``: forms followed to the last. Each round doubles the way;
    a form is so much more frequent than its word that ways are short."""
    current = write_scratch(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = write_scratch(current.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        if moved.filter("on").isEmpty():
            return moved.select("word", "root")
        current = moved.select("word", "root")


def variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    times: int = TIMES,
    noise: int = NOISE,
) -> DataFrame:
    """Rows ``(word, form, root, n, n_near, form_n)`` for every word of the texts.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, of which A-Z is lower-cased. An
    occurrence whose CRC-32 of ``<key>:<run>`` is divisible by ``noise`` loses the letter at the CRC
    modulo the run's length, as a stand-in for misspelling. Kept are words of ``least_letters`` letters
    that come ``least_count`` times. A word's ``form`` is its most frequent near word (of equal ones the
    first by code point), if that comes at least ``times`` as often; ``root`` follows forms to the last.

    A null text has no words; a null key counts as an empty one. Repeated rows count each time. A word
    without a form is its own root. No documents give no rows. Other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    rows = texts(docs, F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    counted = rows.mapInArrow(_count_words(least_letters, noise), "word string, n long")
    words = write_scratch(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count), "words")
    # Combined in each task; of the most frequent near words the first by code point.
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").withColumn("high", -F.col("best.less") >= F.col("n") * times)
    known = write_scratch(
        known.select(
            "word",
            F.when(F.col("high"), F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("high"), -F.col("best.less")).alias("form_n"),
        ),
        "formed",
    )
    roots = _last_forms(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
