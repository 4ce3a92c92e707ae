"""Fingerprints and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom.llm import simhash_dedup as sim
from pairloom.llm.components import components
from pairloom.scratch import write_scratch


def brute_print(text: str | None, width: int = 3) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[int], distance: int) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.fixture(scope="module")
def drifting():
    """Numbers that drift apart a few bits at a time, among them chains and crowded halves."""
    dice = random.Random(3)
    out = []
    for _ in range(12):
        x = dice.getrandbits(64)
        for _ in range(30):
            out.append(x)
            for b in dice.sample(range(64), dice.choice((0, 1, 2, 2, 3, 5))):
                x ^= 1 << b
    low = dice.getrandbits(32)
    out += [dice.getrandbits(12) << 32 | low for _ in range(60)]
    return sorted(set(out))


@pytest.mark.parametrize("distance,hot", [(2, 512), (2, 20), (3, 512), (5, 10**6)])
def test_links_are_all_close_pairs(spark, drifting, distance, hot):
    nodes = spark.createDataFrame([(signed(x),) for x in drifting], "fp long")
    found = {tuple(sorted(r)) for r in sim.links(nodes, distance, hot).collect()}
    wanted = {
        tuple(sorted((signed(a), signed(b))))
        for i, a in enumerate(drifting)
        for b in drifting[:i]
        if (a ^ b).bit_count() <= distance
    }
    assert found == wanted and len(wanted) > 150


def _broadcast(node):
    """Names of the nodes below each broadcast of an executed plan."""
    names = lambda x: [x.nodeName(), *(n for c in _children(x) for n in names(c))]
    return ([names(node)] if node.nodeName() == "BroadcastExchange" else []) + [b for c in _children(node) for b in _broadcast(c)]


def _children(node):
    if node.nodeName() == "AdaptiveSparkPlan":
        return [node.executedPlan()]
    return [node.children().apply(i) for i in range(node.children().size())]


@pytest.mark.parametrize("hot,most", [(512, 1 << 20), (20, 1 << 20), (20, 10)])
def test_exploded_fingerprints_are_not_broadcast(spark, drifting, monkeypatch, hot, most):
    monkeypatch.setattr(sim, "TWICE", most)
    nodes = write_scratch(spark.createDataFrame([(signed(x),) for x in drifting], "fp long"), "nodes")  # a scan has a size
    sent = _broadcast(sim.links(nodes, 2, hot)._jdf.queryExecution().executedPlan())
    assert not any("Generate" in names for names in sent)
    found = {tuple(sorted(r)) for r in sim.links(nodes, 2, hot).collect()}
    assert found == {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(drifting) for b in drifting[:i] if (a ^ b).bit_count() <= 2}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (2000, 1999), (1999, 2000)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(71)}, **{1000 + i: 1000 for i in range(50)}, 1999: 1999, 2000: 1999}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_texts(spark):
    dice = random.Random(1)
    base = ["w%d" % dice.randrange(400) for _ in range(300)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(dice.randrange(3)):
            words[dice.randrange(len(words))] = "x%d" % i
        rows.append((i, dice.choice((" ", "\n", " \t")).join(words)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "One"), (104, "one"), (104, "one"), (105, "É\x0cé"), (106, "a b c"), (None, "a b c")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    found = sim.component_digests(docs).collect()
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints, 2)
    ids = [rows[next(i for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None)][0] for r in roots]
    wanted = sorted((str(k), f"{p:016x}", c) for (k, _), p, c in zip(rows, prints, ids))
    assert sorted((str(r[0]), r[1], r[2]) for r in found) == wanted
    assert sim.component_digests(docs.limit(0)).collect() == []
    assert docs.filter("doc_id = 100").select(F.length("text")).first()[0] is None


def test_one_of_each(spark):
    dice = random.Random(6)
    rows = []
    for g in range(40):
        base = ["w%d" % dice.randrange(3000) for _ in range(200)]
        for c in range(dice.choice((1, 1, 2, 6))):
            rows.append((len(rows) * 7 % 1000, " ".join(base) + (" end" if c > 3 else ""), "x"))
    rows += [(2000, None, "a"), (2001, "", "b"), (None, "only here once", "c"), (None, "only here once", "c"), rows[0], (-1, rows[0][1], "d")]
    rows += [(3000, "one text of this key", "e"), (3000, "another text of this key that stands alone", "e"), (3001, "one text of this key", "e")]
    prints = [brute_print(t) for _, t, _ in rows]
    roots = brute_components(prints, 2)
    group = {}
    for (key, text, _), root in zip(rows, roots):
        group.setdefault(root, []).append((key is None, key or 0, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = sim.one_of_each(docs)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(found) == len(group) == len(set(found))
    least = {root: min(m[:2] for m in members) for root, members in group.items()}
    for key, text in found:
        root = next(r for (k, t, _), r in zip(rows, roots) if (k, t) == (key, text))
        assert least[root] == (key is None, key or 0)
    assert sim.one_of_each(docs.limit(0)).collect() == []


def test_a_very_long_text(spark):
    words = ["w%d" % (i * i % 9973) for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "short")]
    found = sim.component_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0], r[1], r[2]) for r in found) == [
        (k, f"{brute_print(t):016x}", c) for (k, t), c in zip(rows, (1, 1, 3))
    ]


def test_edges_of_a_task_are_joined_up_in_shares(spark, monkeypatch):
    from pairloom.llm import components as parts

    monkeypatch.setattr(parts, "PART_EDGES", 40)
    monkeypatch.setattr(parts, "ship_package", lambda spark: None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        edges = spark.range(0, 500, 1, 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        found = dict(parts.components(edges).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    assert found == {i: 0 for i in range(501)}
