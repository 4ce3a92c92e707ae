"""Marks against brute force: in one index, and through Spark with every special case."""

from __future__ import annotations

import hashlib
import random

import pytest

from pyspark.sql import functions as F

from pairloom.llm import suffix_dedup as sd
from pairloom.scratch import write_scratch


def brute_windows(contexts, length):
    seen, out = set(), []
    for c in contexts:
        flags = []
        for i in range(max(0, len(c) - length + 1)):
            flags.append(c[i : i + length] in seen)
            seen.add(c[i : i + length])
        out.append(flags)
    return out


def brute_documents(rows, length):
    """Rows are (id, text), ids unique; what is left and the number of removed runs, by id."""
    order = sorted(rows)
    out = {}
    for (key, text), flags in zip(order, brute_windows([t.encode() for _, t in order], length)):
        data, gone = text.encode(), bytearray(len(text.encode()))
        for i, again in enumerate(flags):
            if again:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def test_index_on_small_alphabets():
    dice = random.Random(1)
    for _ in range(300):
        letters = dice.choice(["ab", "abcd", "a"])
        base = "".join(dice.choice(letters) for _ in range(60))
        contexts = []
        for _ in range(dice.randrange(1, 14)):
            x = list(base[dice.randrange(30) :][: dice.randrange(50)])
            if x and dice.random() < 0.5:
                x[dice.randrange(len(x))] = dice.choice(letters)
            contexts.append("".join(x).encode())
        length = dice.choice((3, 5, 8))
        assert [f.tolist() for f in sd.repeated_windows(contexts, length)] == brute_windows(contexts, length)


@pytest.fixture(scope="module")
def corpus():
    dice = random.Random(4)

    def prose(n):
        return "".join(dice.choice("abcdefgh é\n") for _ in range(n))

    passage, line, rows = prose(260), prose(110) + "ü", []
    for i in range(120):
        parts = [prose(dice.randrange(0, 300))]
        if dice.random() < 0.5:
            at = dice.randrange(100)
            parts += [passage[at : at + dice.choice((60, 90, 101, 160))], prose(dice.randrange(5))]
        if dice.random() < 0.4:
            parts += [line, prose(30), line]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 40, 2)]  # copies
    rows += [(300 + i, rows[i][1][: len(rows[i][1]) // 2] + "#" + rows[i][1][len(rows[i][1]) // 2 :]) for i in range(40)]
    rows += [(400, "a" * 1000), (401, "ab" * 300), (402, ""), (403, "x" * 99), (404, "x" * 100), (405, "x" * 101), (-5, passage)]
    return rows


@pytest.mark.parametrize("crowded,slice_", [(2_000, 1 << 22), (1, 1 << 22), (2_000, 128)])
def test_documents(spark, corpus, monkeypatch, crowded, slice_):
    monkeypatch.setattr(sd, "CROWDED", crowded)
    monkeypatch.setattr(sd, "_SLICE", slice_)
    docs = spark.createDataFrame([(*r, 1) for r in corpus], "doc_id long, text string, tie int")
    found = {r[0]: tuple(r)[1:] for r in sd.removal_digests(docs).collect()}
    assert found == brute_documents(corpus, 100)


def test_special_rows(spark):
    text, other = "0123456789" * 3 + "".join(map(str, range(100, 160))), "z" * 150
    rows = [(1, None), (2, text), (2, text), (2, other), (None, text), (3, other)]
    found = sorted((str(r["doc_id"]), r["n_removed"]) for r in sd.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # Repeated rows are one document; "z" * 150 repeats itself; a null key is last.
    assert found == [("1", 0), ("2", 0), ("2", 0), ("2", 149), ("3", 150), ("None", len(text))]
    assert sd.removal_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_shared_passage_is_no_large_group(spark, monkeypatch):
    """Every document brings other text around the passage, so all contexts at its ends differ."""
    dice = random.Random(9)
    prose = lambda n: "".join(dice.choice("abcdefgh ") for _ in range(n))
    passage = prose(300)
    rows = [(i, prose(90) + passage + prose(90)) for i in range(80)]
    real, most = sd._search_shards, 20

    def watched(length):
        run = real(length)

        def counted(batches):
            batches, seen = list(batches), {}
            for batch in batches:
                for gram in batch.column("gram").to_pylist():
                    seen[gram] = seen.get(gram, 0) + 1
            assert max(seen.values(), default=0) <= most, seen
            return run(iter(batches))

        return counted

    monkeypatch.setattr(sd, "CROWDED", most)
    monkeypatch.setattr(sd, "_search_shards", watched)
    found = sd.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == brute_documents(rows, 100)


def test_segments_of_a_crowded_passage_are_few(spark, monkeypatch):
    """Rows per round follow the contexts, not their windows, and no index gets a large group."""
    dice = random.Random(10)
    prose = lambda n: "".join(dice.choice("abcdefgh ") for _ in range(n))
    passage, written, real = prose(400), {}, sd.write_scratch

    def counted(df, tag):
        out = real(df, tag)
        written.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(sd, "CROWDED", 10)
    monkeypatch.setattr(sd, "write_scratch", counted)
    rows = [(i, prose(60 + i % 50) + passage + prose(90)) for i in range(60)]
    found = sd.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == brute_documents(rows, 100)
    contexts = 60 * 6  # at most so many anchors whose windows reach over an end
    assert len(written["segments"]) >= 3 and max(written["segments"]) <= 2 * sd.PARTS * contexts


def test_equal_segments_are_not_broadcast_by_their_size_on_disk(spark):
    """Equal texts take little space on disk, and all of it in a broadcast."""
    rows = write_scratch(spark.range(0, 3000).selectExpr("id doc", "id % 300 AS low", "repeat('x', 500) AS content"), "rows")
    groups = write_scratch(rows.groupBy("low", "content").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "groups")
    met = sd._meet(rows, groups, ["low", "content"])
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 3000 and met.filter("n <> 10 OR first <> low").count() == 0
