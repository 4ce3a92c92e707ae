"""Near words and forms against comparing all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import spelling as sp


def brute_words(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def made_up(n):
    """Words with all kinds of neighbours: chains, anagrams, repeated letters, letters beyond ASCII."""
    dice, out = random.Random(5), []
    for _ in range(n):
        word = "".join(dice.choice("abcdeeéÿzq×") for _ in range(dice.randrange(6, 11)))
        for _ in range(6):
            out.append(word)
            at = dice.randrange(len(word))
            word = word[:at] + dice.choice(("", "e", "é", "zz", word[at] * 2)) + word[at + dice.randrange(2) :]
        out.append("".join(dice.sample(out[-1], len(out[-1]))))
    return sorted({w for w in out if w})


@pytest.mark.parametrize("frontier", [1 << 17, 40])
def test_the_trie_finds_all_near_words_once(monkeypatch, frontier):
    monkeypatch.setattr(sp, "FRONTIER", frontier)
    words = made_up(150) + ["x" * 300, "x" * 301, "x" * 299 + "y", "a" * 254, "a" * 255, "a" * 256, "a" * 257]
    held = sp.Words(words)
    a, b = sp.Trie(held).near(held)
    found = [tuple(sorted((words[i], words[j]))) for i, j in zip(a, b)]
    wanted = {tuple(sorted((x, y))) for i, x in enumerate(words) for y in words[:i] if one_apart(x, y)}
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > 300


@pytest.mark.parametrize("depth", [1, 3, 5, sp.LEVELS])
def test_cells_reach_all_near_words(depth):
    words = made_up(60) + ["a" * 254, "a" * 255, "a" * 256, "a" * 257, "a" * 255 + "e", "e" * 256 + "a", "e" * 255 + "a"]
    counts = sp.Words(words).counts
    own = [bytes(row) for row in np.minimum(counts, 255).astype(np.uint8)[:, :depth]]
    reached = sp.reached_cells(counts, depth)
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            if one_apart(x, y):
                assert own[j] in reached[i] or own[i] in reached[j]


@pytest.mark.parametrize("cell", [60_000, 20])
def test_variants(spark, monkeypatch, cell):
    monkeypatch.setattr(sp, "CELL", cell)
    monkeypatch.setattr(sp, "HELD", 50)
    dice = random.Random(3)
    words, rows = made_up(60), []
    often = {w: dice.choice((1, 1, 2, 3, 30, 400)) for w in words}
    pool = [w for w, n in often.items() for _ in range(n)]
    dice.shuffle(pool)
    for i in range(0, len(pool), 40):
        text = dice.choice((" ", "\n", "1", "日", "_")).join(dice.choice((str.upper, str, str)) (w) if w.isascii() else w for w in pool[i : i + 40])
        rows.append((i, text))
    # A chain: each ten times as frequent as the one before.
    rows += [(10_000 + i, w) for i, w in enumerate(["chainedab"] * 2 + ["chainedabc"] * 30 + ["chainedabcd"] * 400)]
    rows += [(None, "kkkkkkkkkk " * 40), (None, None), (7, ""), rows[0], rows[0], (8, "y" * 5_000 + " " + "y" * 5_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    found = [tuple(r) for r in sp.variants(docs).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    assert any(r[1] is not None and r[2] != r[1] for r in found)
    assert sp.variants(docs.limit(0)).collect() == []
