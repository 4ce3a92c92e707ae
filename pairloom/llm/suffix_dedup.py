"""Exact removal of repeated byte strings with run-length text indexes over content-chosen shards.

Removed is every byte that a string of ``length`` bytes covers which also starts earlier: in a
document of smaller id, or earlier in the same one. Strings never cross documents and are judged
on the input.

Windows of ``length`` bytes that are equal must meet, and without moving every window:

1. Every window is owned by an *anchor*: the place in it where a hash of ``GRAM`` bytes is least
   (the last such place). The anchor depends on the window's bytes alone, so equal windows have
   anchors of equal hash at equal offsets. Neighbouring windows mostly share their anchor, so a
   text has about one anchor per 34 bytes, each with a *context*: all bytes of its windows.
2. Anchors are grouped by hash. A hash that occurs once is done. Of occurrences with the same
   whole context, all windows of all but the first start earlier as well. Copies within one chunk
   of texts are told apart before the shuffle, and go their own way: a passage that fills the
   corpus does not fill one task.
3. First occurrences whose hash has further contexts go to index shards (by hash, so shards are
   independent). A shard's contexts form one text; its suffixes are sorted, the Burrows-Wheeler
   transform is cut into runs, and suffix-array entries are kept at run ends only, with one match
   measured per run. Matching statistics of all other positions are streamed from those samples:
   going left from a sampled position, the match partner goes left too and the match grows by one. Statistics of ``length`` or more link a
   window to an equal one; of each chain of links all but the first window start earlier.
4. A hash with very many contexts would make a large shard: a passage that very many documents
   share, with other text around it in each. Such contexts are cut, by how far a window begins before
   its anchor, into a few segments, runs of windows. All windows of a segment share a *core* of bytes,
   so segments can only have equal windows if their cores are equal. Of equal segments all but the
   first start earlier; a core that comes once is done; cores of few segments go to index shards; those
   of many are cut again. Segments are compared by their bytes, with combining before the shuffle,
   and a context has few segments that are still open, since most lie in the passage (all equal) or
   reach out of it (all different).

Copies of a whole text are set aside first: of them only the first is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import chunks, texts
from pairloom.scratch import write_scratch
from pairloom.session import ship_package

GRAM = 28  # bytes that an anchor's hash covers
CROWDED = 2_000  # contexts of one hash (segments of one core) beyond which they are cut, before they are indexed
PARTS = 4  # segments that a run of windows is cut to
BROADCAST_ANCHORS = 200_000  # anchors of crowded hashes that are broadcast to their texts
BROADCAST_KEYS = 100_000  # crowded segments or cores that are broadcast, at most ``length + 71`` bytes each
SHARD_BYTES = 1 << 17  # text of one index, about; whole hashes are kept together. Its arrays fit a core's cache

# ---------------------------------------------------------------- anchors


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses
_TABLES = [np.random.default_rng(i).integers(0, 1 << 64, 256, np.uint64) for i in (1, 2)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substrings of ``data``, from one pass of prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        n, base = len(data), _BASES[which]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * _powers(n, base), out=self.sums[1:])
        self.undo = _powers(n + 1, pow(base, -1, 1 << 64))

    def of(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.undo[begin])


def _last_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the last least value in each window of ``width`` values."""
    places, have = np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left, right = places[:-step], places[step:]
        places = np.where(values[right] <= values[left], right, left)
        have += step
    return places


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end; text ``i`` is ``data[bounds[i]:bounds[i + 1]]``.

    Per anchor: text, first owned window in ``data``, number of owned windows, hash of the gram,
    and another hash of the whole context together with its windows' place.
    """
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < length:
        return none
    first, second = Rolling(data, 0), Rolling(data, 1)
    grams = first.of(slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    owner = _last_least((grams >> np.uint64(32)).astype(np.uint32), length - GRAM + 1)
    last = np.maximum(np.diff(bounds) - length + 1, 0)  # windows per text
    windows = np.repeat(bounds[:-1] - np.cumsum(last) + last, last) + np.arange(int(last.sum()))
    if not len(windows):
        return none
    text, owner = np.repeat(np.arange(len(last)), last), owner[windows]
    fresh = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])))
    begin, count = windows[fresh], np.diff(np.append(fresh, len(windows)))
    at, end = owner[fresh], begin + count + length - 1
    place = _mixed(((at - begin).astype(np.uint64) << np.uint64(32)) + count.astype(np.uint64))
    return text[fresh], begin, count, grams[at].view(np.int64), (second.of(begin, end) ^ place).view(np.int64)


# ---------------------------------------------------------------- the index


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by prefix doubling; suffixes are told apart within ``depth`` symbols."""
    n = len(codes)

    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        there = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(1, there[1:] != there[:-1]))
        return order, rank

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[: max(0, n - by)] = x[by:]
        return out

    # As many symbols as a number holds give the first ranks.
    bits, have = int(codes.max() + 1).bit_length(), 1
    first = codes + 1
    while 2 * have * bits < 63:
        first = (first << (have * bits)) + shifted(first, have)
        have *= 2
    order, rank = ranked(first)
    while have < depth and rank[order[-1]] < n:
        order, rank = ranked(rank * (n + 1) + shifted(rank, have))
        have *= 2
    return order


def _match(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the match of the suffixes at ``a`` and ``b``, up to ``most``."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    n = len(codes)
    for k in range(most):
        x, y = a[live] + k, b[live] + k
        good = (x < n) & (y < n)
        live, x, y = live[good], x[good], y[good]
        live = live[codes[x] == codes[y]]
        if not len(live):
            break
        out[live] += 1
    return out


class RunIndex:
    """Run-length Burrows-Wheeler transform of a text, with suffix-array entries at run ends only.

    Of two suffixes next to each other in sorted order with the same symbol before them, the longer
    suffixes are next to each other too. So the partner of a position (the suffix sorted right
    before it) follows from the partner of the position to its right, unless that one heads a run;
    and the run's symbols sort right behind those of the run of the same symbol before it, whose
    end is sampled. One match is measured per run; the suffix array itself is not kept.
    """

    def __init__(self, codes: np.ndarray, depth: int):
        order = suffix_order(codes, depth)
        transform = codes[order - 1]  # the symbol before each suffix; the text is a circle here
        border = np.flatnonzero(np.append(True, transform[1:] != transform[:-1]))
        self.size, self.runs = len(codes), len(border)
        first, last = order[border], order[np.append(border[1:], self.size) - 1]
        sorted_runs = np.argsort(transform[border], kind="stable")
        heads = (first[sorted_runs] - 1) % self.size
        partners = (last[np.roll(sorted_runs, 1)] - 1) % self.size
        match = _match(codes, heads, partners, depth)
        match[0] = 0  # the least suffix has no partner
        by_place = np.argsort(heads)
        self.sampled, self.partner, self.match = heads[by_place], partners[by_place], match[by_place]

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Per position of the text, streamed from the sample to its right: partner, and length of the match."""
        places = np.arange(self.size)
        at = np.searchsorted(self.sampled, places)
        at[at == self.runs] = 0  # around the circle
        back = (self.sampled[at] - places) % self.size
        return (self.partner[at] - back) % self.size, self.match[at] + back


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, in order of precedence: whether each of its windows occurs before."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    codes = np.zeros(int(sizes.sum()) + len(contexts), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    within = np.ones(len(codes), bool)
    within[ends] = False
    # Every context ends with a symbol of its own, so no match runs over an end.
    codes[within] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + len(contexts)
    codes[ends] = np.arange(len(contexts))
    index = RunIndex(codes, int(sizes.max()) + 1)
    partner, match = index.statistics()
    # Follow partners to the head of each chain of matches, halving the way each time.
    head = np.where(match >= length, partner, np.arange(len(codes)))
    while True:
        further = head[head]
        if np.array_equal(further, head):
            break
        head = further
    first = np.full(len(codes), len(codes), np.int64)
    np.minimum.at(first, head, np.arange(len(codes)))
    again = first[head] < np.arange(len(codes))
    return [again[s : s + max(0, n - length + 1)] for s, n in zip(starts.tolist(), sizes.tolist())]


# ---------------------------------------------------------------- on Spark

_ANCHOR = "gram long, whole long, doc long, tie long, begin int, windows int, n int"
_CONTEXT = "gram long, doc long, tie long, begin int, context binary"
_SEGMENT = "low int, high int, top int, windows int, content binary, doc long, tie long, begin int"
_SPAN = "doc long, tie long, begin int, finish int"
_SLICE = 1 << 22  # windows of a long text that are worked on at a time


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [f[0] for f in fields])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch, in order."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def _counted(gram: np.ndarray, whole: np.ndarray, doc: np.ndarray, tie: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For the first occurrence of each context in a chunk: how many there are; 0 for the others.

    An occurrence at the place of the first (of a repeated row) is marked -1.
    """
    order = np.lexsort((begin, tie, doc, whole, gram))
    gram, whole, doc, tie, begin = (x[order] for x in (gram, whole, doc, tie, begin))
    fresh = np.append(True, (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1]))[: len(order)]
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(order)))
    own = np.repeat(first, size)
    again = (doc == doc[own]) & (tie == tie[own]) & (begin == begin[own])
    n = np.where(again, -1, 0)
    n[first] = size
    out = np.empty(len(order), np.int32)
    out[order] = n
    return out


def _find_anchors(length: int):
    def pieces(values: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes, bounds of texts in them, and place of each in its text; a long text comes in slices
        that share ``length - 1`` bytes, so each window is in one slice."""
        data = [v.encode() for v in values]
        if max(map(len, data)) <= _SLICE:
            bounds = np.concatenate(([0], np.cumsum([len(d) for d in data])))
            yield np.frombuffer(b"".join(data), np.uint8), bounds, np.arange(len(data)), np.zeros(len(data), np.int64)
            return
        for i, one in enumerate(data):
            for at in range(0, max(1, len(one) - length + 1), _SLICE):
                part = np.frombuffer(one[at : at + _SLICE + length - 1], np.uint8)
                yield part, np.array([0, len(part)]), np.array([i]), np.array([at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in chunks(batch, "text"):
                for data, bounds, owner, shift in pieces(values):
                    text, begin, count, gram, whole = anchors(data, bounds, length)
                    doc, tie = (rows.column(c).to_numpy()[owner[text]] for c in ("doc", "tie"))
                    begin = begin - bounds[text] + shift[text]
                    n = _counted(gram, whole, doc, tie, begin)
                    # A copy of a context in the same chunk is known to be one: it need not meet its hash.
                    gram = np.where(n == 0, _mixed(doc.view(np.uint64) * np.uint64(_BASES[0]) + begin.astype(np.uint64)).view(np.int64), gram)
                    columns = (gram, whole, doc, tie, begin.astype(np.int32), count.astype(np.int32), n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[n >= 0]) for c in columns], ["gram", "whole", "doc", "tie", "begin", "windows", "n"]
                    )

    return run


def _cut_contexts(length: int):
    """Contexts of one text's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in chunks(batch, "text"):
                out: list[tuple] = []
                for text, row in zip(values, rows.select(["doc", "tie", "wanted"]).to_pylist()):
                    data = text.encode()
                    for a in row["wanted"]:
                        begin, end = a["begin"], a["begin"] + a["windows"] + length - 1
                        out.append((a["gram"], row["doc"], row["tie"], begin, data[begin:end]))
                yield _batch(out, _CONTEXT)

    return run


def anchor_place(context: bytes, length: int) -> int:
    """Where the anchor that owns a context's windows begins in it."""
    data = np.frombuffer(context, np.uint8)
    grams = Rolling(data, 0).of(slice(0, len(data) - GRAM + 1), slice(GRAM, len(data) + 1))
    return int(_last_least((grams >> np.uint64(32)).astype(np.uint32), length - GRAM + 1)[0])


def _cut_segments(length: int):
    """Contexts of one text's anchors as one segment each, over all places of an anchor in a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in chunks(batch, "text"):
                out: list[tuple] = []
                for text, row in zip(values, rows.select(["doc", "tie", "wanted"]).to_pylist()):
                    data = text.encode()
                    for a in row["wanted"]:
                        begin = a["begin"]
                        content = data[begin : begin + a["windows"] + length - 1]
                        out.append((0, length - GRAM, anchor_place(content, length), a["windows"], content, row["doc"], row["tie"], begin))
                yield _batch(out, _SEGMENT)

    return run


def _split(segments: DataFrame, length: int) -> DataFrame:
    """Segments cut to ``PARTS`` along the places that an anchor has in their windows.

    A segment's windows begin ``top``, ``top - 1``, ... bytes before the anchor; the cell that it lies
    in has all places from ``low`` to ``high``, and cells are cut alike for all contexts.
    """
    part = segments.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = part.withColumns(
        {
            "from": F.expr(f"low + part * (high - low + 1) div {PARTS}").cast("int"),
            "to": F.expr(f"low + (part + 1) * (high - low + 1) div {PARTS} - 1").cast("int"),
        }
    )
    first = F.least("top", "to")
    count = first - F.greatest(F.col("top") - F.col("windows") + 1, F.col("from")) + 1
    part = part.withColumns({"first": first, "count": count, "skip": F.col("top") - first}).filter("from <= to AND count > 0")
    return part.select(
        F.col("from").alias("low"), F.col("to").alias("high"), F.col("first").alias("top"), F.col("count").alias("windows"),
        F.substring("content", F.col("skip") + 1, F.col("count") + (length - 1)).alias("content"),
        "doc", "tie", (F.col("begin") + F.col("skip")).alias("begin"),
    )


def _meet(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their group. Groups of more than ``CROWDED`` rows, which are few, are broadcast, so that
    these rows stay where they are. Equal texts are small on disk, so Spark's size of these tables says nothing
    about their size in memory: nothing else is broadcast."""
    crowded = groups.filter(F.col("n") > CROWDED)
    few = crowded.count()
    if few == 0 or few > BROADCAST_KEYS:
        return rows.join(groups.hint("merge"), on)
    return rows.join(F.broadcast(crowded), on).unionByName(rows.join(groups.filter(F.col("n") <= CROWDED).hint("merge"), on))


def split_crowded(segments: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts ``(gram, doc, tie, begin, context)`` to be indexed, no more than ``CROWDED`` of a gram, and
    spans ``(doc, tie, begin, finish)`` of windows that start earlier. Both lists have one table per round."""
    same, here = ["low", "high", "top", "windows", "content"], F.struct("doc", "tie", "begin")
    contexts, spans = [], []
    while True:  # a cell has a PARTS-th of the places of the one before; at one place, equal cores are equal segments
        segments = write_scratch(_split(segments, length), "segments")
        firsts = write_scratch(segments.groupBy(*same).agg(F.min(here).alias("first"), F.count("*").alias("n")), "firsts")
        again = _meet(segments, firsts.filter("n > 1"), same).filter(here != F.col("first"))
        spans.append(again.select("doc", "tie", "begin", (F.col("begin") + F.col("windows") + (length - 1)).alias("finish")))
        core = F.substring("content", F.col("top") - F.col("low") + 1, F.lit(length) - (F.col("high") - F.col("low")))
        held = firsts.select(*same, "first.*", core.alias("core"))
        cores = write_scratch(held.groupBy("low", "high", "core").agg(F.count("*").alias("n")).filter("n > 1"), "cores")
        calm = held.join(cores.filter(F.col("n") <= CROWDED).hint("merge"), ["low", "high", "core"])
        contexts.append(calm.select(F.xxhash64("low", "high", "core").alias("gram"), "doc", "tie", "begin", F.col("content").alias("context")))
        crowded = cores.filter(F.col("n") > CROWDED)
        if crowded.isEmpty():
            return contexts, spans
        segments = _meet(held, crowded, ["low", "high", "core"]).select(*same, "doc", "tie", "begin")


def _search_shards(length: int):
    """Rows come sorted by hash and precedence; whole hashes are gathered to shards and indexed."""

    def marks(shard: list[tuple]) -> pa.RecordBatch:
        # Precedence first: hashes do not share windows, so one order does for all. Repeated rows of
        # a document bring the same context at the same place again; it is one.
        shard = sorted({r[1:4]: r for r in shard}.values(), key=lambda r: r[1:4])
        spans = []
        for (_, doc, tie, begin, _), flags in zip(shard, repeated_windows([r[4] for r in shard], length)):
            spans += [(doc, tie, begin + b, begin + e - 1 + length) for b, e in _runs(flags)]
        return _batch(spans, _SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc", "tie", "begin", "context"))):
                if row[0] != last and size >= SHARD_BYTES:
                    yield marks(shard)
                    shard, size = [], 0
                shard.append(row)
                size, last = size + len(row[4]), row[0]
        if shard:
            yield marks(shard)

    return run


def _repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """``(doc, tie, spans)`` of texts with something to remove; ``docs`` has doc, tie, text and maybe more.

    Precedence is by ``doc``, then ``tie``. ``spans`` are byte ranges that may overlap.
    """
    here = F.struct("doc", "tie", "begin")
    per_gram, per_context = Window.partitionBy("gram"), Window.partitionBy("gram", "whole")
    # One shuffle serves all three windows; hashes that occur once are dropped by the first.
    known = write_scratch(
        docs.select("doc", "tie", "text")
        .mapInArrow(_find_anchors(length), _ANCHOR)
        .repartition("gram")
        .withColumn("total", F.sum("n").over(per_gram))
        .filter("total > 1 OR n = 0")
        .withColumn("copy", (F.col("n") == 0) | (here != F.min(here).over(per_context)))
        .withColumn("contexts", F.count_if(~F.col("copy")).over(per_gram))
        .drop("n", "total", "whole"),
        "anchors",
    )
    copies = known.filter("copy").select("doc", "tie", "begin", (F.col("begin") + F.col("windows") - 1 + length).alias("finish"))
    wanted = (
        known.filter(f"NOT copy AND contexts > 1 AND contexts <= {CROWDED}")
        .groupBy("doc", "tie")  # at most the anchors of one text
        .agg(F.collect_list(F.struct("gram", "begin", "windows")).alias("wanted"))
    )
    # All columns of the texts come along: so this shuffle of theirs is the one that the result joins.
    contexts = docs.join(wanted, ["doc", "tie"]).select(*docs.columns, "wanted").mapInArrow(_cut_contexts(length), _CONTEXT)
    crowded = known.filter(f"NOT copy AND contexts > {CROWDED}")
    n_crowded = crowded.count()
    if n_crowded:
        listed = crowded.groupBy("doc", "tie").agg(F.collect_list(F.struct("begin", "windows")).alias("wanted"))
        listed = F.broadcast(listed) if n_crowded <= BROADCAST_ANCHORS else listed
        segments = docs.select("doc", "tie", "text").join(listed, ["doc", "tie"]).mapInArrow(_cut_segments(length), _SEGMENT)
        for more, earlier in zip(*split_crowded(segments, length)):
            contexts, copies = contexts.union(more), copies.union(earlier)
    shards = contexts.repartition("gram").sortWithinPartitions("gram", "doc", "tie", "begin")
    spans = copies.union(shards.mapInArrow(_search_shards(length), _SPAN))
    return spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("begin", "finish")).alias("spans"))


def _cut_out(as_text: bool):
    kind = pa.string() if as_text else pa.binary()
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in chunks(batch, "text"):
                kept, removed = [], []
                for text, spans in zip(values, rows.column("spans").to_pylist()):
                    data, at, out = text.encode(), 0, []
                    joined = merged([(s["begin"], s["finish"]) for s in spans or ()])
                    for begin, end in joined:
                        out.append(data[at:begin])
                        at = end
                    left = b"".join([*out, data[at:]])
                    kept.append(left.decode(errors="ignore") if as_text else left)
                    removed.append([{"begin": b, "end": e} for b, e in joined])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("rest"), rows.column("n_bytes"), pa.array(kept, kind), pa.array(removed, span)], ["rest", "n_bytes", "kept", "removed"]
                )

    return run


def remove_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", as_text: bool = False) -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``kept`` (what is left) and ``removed`` (byte ranges).

    ``kept`` is binary, since a cut may fall inside a character; ``as_text`` makes it a string
    without the parts of such characters. The key must be a whole number. A null text is empty; a
    text shorter than ``length`` loses nothing. Rows that share key and text are one document and
    come back alike, once per row; of rows that share only the key, the order is by a hash of the
    text. A null key comes last. Columns named ``n_bytes``, ``kept`` or ``removed`` are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    others = [c for c in docs.columns if c not in ("text", "n_bytes", "kept", "removed")]
    rows = texts(
        docs,
        F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"),
    )
    # The text's hash only matters for keys that are not unique.
    shared = write_scratch(rows.groupBy("doc").count().filter("count > 1").select("doc", F.lit(True).alias("shared")), "shared")
    tie = F.lit(0).cast("long")
    if not shared.isEmpty():
        rows = rows.join(shared, "doc", "left")
        tie = F.when(F.col("shared"), F.xxhash64("text")).otherwise(0)
    rows = rows.select("doc", tie.alias("tie"), "text", "rest")
    spans = _repeated_spans(rows, length)
    out = rows.join(spans, ["doc", "tie"], "left").select("rest", F.octet_length("text").cast("long").alias("n_bytes"), "text", "spans")
    kind = out.schema["rest"].dataType.simpleString()
    schema = f"rest {kind}, n_bytes long, kept {'string' if as_text else 'binary'}, removed array<struct<begin: int, end: int>>"
    return out.mapInArrow(_cut_out(as_text), schema).select("rest.*", "n_bytes", "kept", "removed")


def removal_digests(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of what is left."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
