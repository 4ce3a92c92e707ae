"""Near-duplicates by SimHash, found with deletion-variant signatures.

Two fingerprints that differ in at most ``2 * s - 1`` bits, cut into ``s`` segments, have a
segment in which they differ by at most one bit. So every segment is indexed as it is and with
each of its set bits deleted (one wildcard, read as zero), and looked up as it is: an equality
join on segment and value meets every pair, and the whole fingerprints are then compared.

A segment value shared by very many fingerprints would meet all their pairs. Fingerprints with
such a value instead look up, by an equality join on whole fingerprints, each fingerprint that
differs from them by few enough bits. Nothing is dropped in either form.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import texts
from pairloom.llm.components import components
from pairloom.scratch import write_scratch
from pairloom.session import ship_package

BITS = 64
SEED = 42
TWICE = 1 << 20  # left-out rows or fingerprints that are broadcast, at 16 bytes each


def shingle_hashes(text: str, width: int) -> bytes:
    """XXH64 of each ``width``-word shingle, repeats included, 8 bytes each, highest first.

    Words are runs without ASCII white space, after lower-casing A-Z. Fewer words than ``width``
    are one shingle; no word gives none.
    """
    words = text.encode().lower().split()
    if not words:
        return b""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined = memoryview(b" ".join(words))
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :][:n].tolist()
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[i:j], SEED) for i, j in zip(first, last)])


def _majority(hashes: np.ndarray) -> bytes:
    """Bits set in over half the rows of a matrix of 64-bit words, highest bit of the first word first."""
    n, words = hashes.shape
    counts = np.zeros(words * 64, np.int64)
    step = 255 * 64  # rows of a block: no large array for a long text, and sums of 255 fit a byte
    for at in range(0, n, step):
        bits = np.unpackbits(hashes[at : at + step].astype(">u8").view(np.uint8).reshape(-1, words * 8), axis=1)
        whole = len(bits) // 255 * 255
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
        if whole:
            counts += bits[:whole].reshape(-1, 255, words * 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprint(text: str, width: int) -> int:
    """64-bit SimHash over a text's shingles, as an unsigned number; zero without a word."""
    return int.from_bytes(_majority(np.frombuffer(shingle_hashes(text, width), ">u8").reshape(-1, 1)), "big")


def fingerprints(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp, text_id)`` per row of ``docs``; ``fp`` is the fingerprint's bits as a signed long,
    ``text_id`` a hash of the text."""
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py() or "", width) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), batch.column(2)], [key, "fp", "text_id"])

    wanted = texts(docs, F.col(f"`{key}`"), F.col(f"`{text}`"), F.xxhash64(text).alias("text_id"))
    return wanted.mapInArrow(run, f"`{key}` {kind}, fp long, text_id long")


def _segments(distance: int, bits: int = BITS) -> list[range]:
    """As few segments as make one differ by at most one bit."""
    count = distance // 2 + 1
    edges = [bits * i // count for i in range(count + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:])]


def _value(fp: Column, bits: range) -> Column:
    """A segment's bits, lowest first."""
    width = len(bits)
    moved = F.shiftrightunsigned(fp, bits.start)
    return moved if width == BITS else moved.bitwiseAND(F.lit((1 << width) - 1))


def links(nodes: DataFrame, distance: int, hot: int = 512) -> DataFrame:
    """Pairs ``(a, b)`` of different fingerprints in ``nodes.fp`` (unique) that differ in ``distance`` bits or fewer.

    A pair may come more than once. ``hot``: a segment value that more fingerprints share goes
    the other way; the pairs are the same for any number.
    """
    segments = _segments(distance)
    keyed = nodes.select(
        "fp", F.posexplode(F.array(*(_value(F.col("fp"), s) for s in segments))).alias("segment", "value")
    )
    counts = keyed.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    crowded = write_scratch(counts.select("segment", "value", F.lit(True).alias("crowded")), "crowded")
    plain = crowded.isEmpty()
    if not plain:
        keyed = write_scratch(keyed.join(crowded, ["segment", "value"], "left").fillna(False, ["crowded"]), "keyed")
    calm = keyed if plain else keyed.filter(~F.col("crowded"))
    width = max(map(len, segments))
    stored = calm.select(F.col("fp").alias("a"), "segment", "value")
    # Set bits, each deleted in turn; the value itself stands for no deletion.
    variants = F.filter(
        F.array(F.col("value"), *(F.when(F.col("value").bitwiseAND(F.lit(1 << i)) != 0, F.col("value").bitwiseAND(F.lit(~(1 << i)))) for i in range(width))),
        lambda x: x.isNotNull(),
    )
    asked = calm.select(F.col("fp").alias("b"), "segment", F.col("value").alias("own"), F.explode(variants).alias("value"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # Equal values meet twice, once from either side.
    once = (F.col("own") != F.col("value")) | (F.col("a") < F.col("b"))
    # Spark sizes exploded rows as if each came once, so neither of these tables may be broadcast by that size.
    pairs = stored.join(asked.hint("merge"), ["segment", "value"]).filter(close & once).select("a", "b")
    if plain:
        return pairs
    flips = [0]
    for n in range(1, distance + 1):
        flips += [sum(1 << i for i in chosen) for chosen in combinations(range(BITS), n)]
    flips = [x - (1 << 64) if x >= 1 << 63 else x for x in flips[1:]]
    dense = keyed.filter("crowded").select(F.col("fp").alias("a")).distinct()
    near = dense.select("a", F.explode(F.lit(np.array(flips, np.int64))).alias("flip")).select(
        "a", F.col("a").bitwiseXOR(F.col("flip")).alias("b")
    )
    known = nodes.select(F.col("fp").alias("b"))
    near, known = (near, F.broadcast(known)) if known.count() <= TWICE else (near.hint("merge"), known)
    return pairs.union(near.join(known, "b").select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, key: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: its key, ``fp``, and ``component_id``, the smallest key its fingerprint reaches.
    ``also`` may name ``text_id``, a 64-bit hash of the row's text, and ``root``, a fingerprint that
    stands for the component (components share an id if their smallest keys are equal).

    Rows with equal fingerprints are linked, and links are followed. A null text is an empty one;
    all texts without a word share the fingerprint zero. Repeated rows come back repeated. A null
    key never becomes a component's id unless the component has no other.
    """
    prints = write_scratch(fingerprints(docs, width, key).select(key, "fp", *[c for c in also if c == "text_id"]), "prints")
    nodes = write_scratch(prints.groupBy("fp").agg(F.min(key).alias("first_key")), "nodes")
    found = write_scratch(components(links(nodes, distance)), "members")
    rooted = nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", "first_key", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_key").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id", *[c for c in also if c == "root"])
    return prints.join(named, "fp")


def component_digests(docs: DataFrame) -> DataFrame:
    """Document, fingerprint as 16 hexadecimal digits, and component."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, width: int = 3, distance: int = 2, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row of smallest key, once; all columns stay.

    Of rows that share the smallest key, one text stays, the one of lowest hash. Rows with a null key
    are kept if their group has no other key. Texts are not shuffled: they meet a list of the rows
    that go, which is broadcast if it is short.
    """
    groups = write_scratch(near_duplicates(docs, width, distance, key, ("text_id", "root")), "groups")
    first = groups.filter(F.col(key).eqNullSafe(F.col("component_id")))
    held = first.groupBy(key, "root").agg(F.min("text_id").alias("own"), F.count("*").alias("rows"))
    several = write_scratch(held.filter("rows > 1"), "held")
    named = [F.col(key).alias("_key"), F.col("text_id").alias("_id")]
    gone = groups.filter(~F.col(key).eqNullSafe(F.col("component_id"))).select(*named)
    if not several.isEmpty():  # rows that share a group's smallest key: other texts go, and copies of the row
        same = several.select(F.col(key).alias("_held"), F.col("root").alias("_root"), "own")
        there = F.col(key).eqNullSafe(F.col("_held")) & (F.col("root") == F.col("_root")) & (F.col("own") != F.col("text_id"))
        gone = gone.union(first.join(same, there).select(*named))
    gone = write_scratch(gone.distinct(), "gone")
    left = _without(docs, gone, key)
    if several.isEmpty():
        return left
    again = write_scratch(several.select(F.col(key).alias("_key"), F.col("own").alias("_id")), "again")
    return _without(left, again, key).unionByName(_without(left, again, key, "left_semi").dropDuplicates([key, "text"]))


def _without(docs: DataFrame, listed: DataFrame, key: str, how: str = "left_anti") -> DataFrame:
    """Rows of ``docs`` that are not (or are) listed by ``(_key, _id)``, key and hash of the text."""
    listed = F.broadcast(listed) if listed.count() <= TWICE else listed
    return docs.join(listed, F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64("text") == F.col("_id")), how)
