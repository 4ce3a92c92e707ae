"""Pieces against the tokenizer itself; packings are checked for every rule, and against the fewest bins."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairloom.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")


def checked(sizes, packing, capacity):
    assert sorted(i for b in packing for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= capacity for b in packing)
    return len(packing)


def test_injected_bins_stay_whole():
    dice = random.Random(1)
    sizes = [dice.randrange(1, 60) for _ in range(300)]
    order = sorted(range(300), key=lambda i: -sizes[i])
    parent = pk.best_fit(dice.sample(order, 300), sizes, [], 100)
    giver = pk.best_fit(order, sizes, [], 100)
    child = pk.inject(parent, giver[:20], sizes, 100)
    checked(sizes, child, 100)
    assert all(b == c[: len(b)] for b, c in zip(giver[:20], child))


def test_breeding_beats_best_fit():
    """Triplets that fill a bin exactly, which best fit by falling length misses."""
    dice, won = random.Random(4), 0
    for seed in range(6):
        sizes = []
        for _ in range(20):
            a, b = dice.randrange(380, 490), dice.randrange(250, 300)
            sizes += [a, b, 1000 - a - b]
        plain = len(pk.best_fit(sorted(range(60), key=lambda i: -sizes[i]), sizes, [], 1000))
        bred = checked(sizes, pk.breed(sizes, 1000, seed), 1000)
        with_patterns = [sorted(sizes[i : i + 3], reverse=True) for i in range(0, 60, 3)]
        led = checked(sizes, pk.breed(sizes, 1000, seed, None, with_patterns), 1000)
        assert 20 <= led <= bred <= plain
        won += led < plain
        assert pk.breed(sizes, 1000, seed) == pk.breed(sizes, 1000, seed)
    assert won >= 4


@pytest.mark.parametrize("island", [4_000, 60])
def test_documents(spark, monkeypatch, island):
    monkeypatch.setattr(pk, "ISLAND", island)
    dice = random.Random(2)
    word = lambda: "".join(dice.choice("abcdefgh é日!<|>") for _ in range(dice.randrange(1, 9)))
    rows = [(i, " ".join(word() for _ in range(dice.choice((0, 3, 40, 200, 600))))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "w " * 2047), (303, "w " * 2048), (304, "w " * 9000), (305, "a <|endoftext|> b"), (None, "no key"), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, offset string, other string")
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    wanted = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, begin in enumerate(range(0, len(ids), 2048)):
            cut = np.array(ids[begin : begin + 2048], "<u4")
            wanted.append((str(key), k, begin, len(cut), zlib.crc32(cut.tobytes())))
    found = pk.packing_digests(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(wanted)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    needed = -(-sum(w[3] for w in wanted) // 2048)
    assert len(bins) <= needed + 2
    assert pk.packing_digests(docs.limit(0), PATH).collect() == []


def test_ids_and_columns_come_along(spark):
    docs = spark.createDataFrame([(1, "one two three", "x"), (2, None, "y")], "doc_id long, text string, other string")
    found = {r["doc_id"]: r for r in pk.pack(pk.pieces(docs, PATH, with_ids=True)).collect()}
    assert found[2]["ids"] == [0] and found[1]["ids"][-1] == 0 and len(found[1]["ids"]) == found[1]["length"]
    assert found[1]["other"] == "x" and found[1]["sequence_id"] == found[2]["sequence_id"]


def test_words_one_by_one_are_the_whole_text(monkeypatch):
    """Whatever white space parts words, and in every generation of the cache, ids are the tokenizer's own."""
    monkeypatch.setattr(pk.WordIds, "MOST_PIECES", 40)
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    dice, known = random.Random(8), pk.WordIds(tokenizer)
    alphabet = [*"aAbBzé'sdtI1٣,.!-_Σς日😀\u0301\u0130ﬁ", " ", "\n", "\t", "\u00a0", "\u2003", "\u0085", "\x1c", "\x1f", "\u200b", "'ll", "<|endoftext|>", "  "]
    for _ in range(40):
        texts = ["".join(dice.choice(alphabet) for _ in range(dice.randrange(60))) for _ in range(25)] + ["", " ", "w" * 700]
        for text, ids in zip(texts, known.of_texts(texts, 0)):
            assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], text


def test_a_word_is_kept_once_whatever_marks_it_has():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    known = pk.WordIds(tokenizer)
    known.of_texts(['Große große, (GROSSE) "grosse" große... grosse;'], 0)
    assert sorted(w for w in known if w[0].isalpha()) == ["grosse", "große"]
    dice = random.Random(7)
    alphabet = list("abS'tRElv  ,.!?(1²ªßÀ×\t\xa0\x85\xad<|>") + ["'s", "'LL", "\u0301", "\u0338", "=", "İ", "Σ", "“", "’", "日", "\U0001f600", "\x1c"]
    values = ["", *("".join(dice.choice(alphabet) for _ in range(dice.randrange(40))) for _ in range(2_000)), ""]
    values += [f"x{chr(a)}{chr(b)}s" for a in range(256) for b in (*range(0x20, 0x80), 0xA0, 0xB2, 0xC0, 0xDF)]
    expected = [[*e.ids, 0] for e in tokenizer.encode_batch(values, add_special_tokens=False)]
    assert [ids.tolist() for ids in pk.WordIds(tokenizer).of_texts(values, 0)] == expected
