"""Divergences against plain counting in whole numbers, and trees against plain sums."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least, top=50, smoothing=5, scale=10**9):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        sources = sorted({d[1] for d in docs if d[0] == lang})
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if t in kept) for s in sources}
        whole = sum(counts.values(), Counter())
        value = lambda c, t: 1 + scale * (c[t] + smoothing) // (sum(c.values()) + smoothing * len(kept))
        for s in sources:
            pairs = [(o, sum(abs(value(counts[s], t) - value(counts[o], t)) for t in kept)) for o in sources if o != s]
            terms = [(t, value(counts[s], t) - value(whole, t)) for t in counts[s] if value(counts[s], t) > value(whole, t)]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def test_equal_pairs_of_nodes_are_priced_once():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 3, (6, 64)) * (rng.random((6, 64)) < 0.4)
    counts[3] = counts[1]
    counts[:, 50:] = -1
    trees = sd.Trees(counts)
    assert trees.roots[1] == trees.roots[3] and sum(map(len, trees.left)) < 6 * 63
    for a in range(6):
        for b in range(6):
            of_a, of_b = (sd._values(trees.leaves, int(counts[i][:50].sum()), 50, 5, 10**9) for i in (a, b))
            lookup = lambda of, i: np.array([of[np.searchsorted(trees.leaves, n)] for n in counts[i]])
            assert trees.price(a, b, of_a, of_b) == int(np.abs(lookup(of_a, a) - lookup(of_b, b)).sum())


def test_values_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    numbers = [(9 * 10**17, 10**18, 12_345), (3, 10**18, 1), (0, 0, 7)]
    df = spark.createDataFrame(numbers, "n long, total long, terms long")
    found = [r[0] for r in df.select(sd._share(F.col("n"), F.col("total"), F.col("terms"), 5, 10**9)).collect()]
    assert found == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in numbers]
    assert [int(sd._values(np.array([n]), t, v, 5, 10**9)[0]) for n, t, v in numbers] == found


@pytest.mark.parametrize("block,chunk,held,slice_,kept", [(1 << 12, 48, 200_000, 1 << 22, 32 << 20), (8, 2, 10, 64, 0)])
def test_audit(spark, monkeypatch, block, chunk, held, slice_, kept):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("HELD", held), ("SLICE", slice_), ("KEPT_BYTES", kept)):
        monkeypatch.setattr(sd, name, value)
    dice = random.Random(7)
    words = ["".join(dice.choice("abcdé日Zz") for _ in range(dice.randrange(1, 5))) for _ in range(60)]
    rows = []
    for i in range(200):
        lang, source = dice.choice(["de", "en", None]), dice.choice(["a", "b", "c", "ä", "hot", "hot", "hot", None])
        rows.append((dice.choice(" -1\n\x7f").join(dice.choice(words) for _ in range(dice.randrange(0, 40))), lang, source))
    rows += [rows[0], rows[0], (None, "de", "silent"), ("", "de", "silent"), ("x y", "bare", "one"), ("y", "bare", "two"), ("!", "bare", None)]
    rows += [("long " * 5_000 + "w" * 3_000, "en", "a")]
    docs = spark.createDataFrame([(i, *r, 1, 2, "x") for i, r in enumerate(rows)], SCHEMA + ", n long, value long, item string")
    found = sorted(tuple(r) for r in sd.audit(docs, least_docs=6).collect())
    assert found == brute(rows, 6)
    assert {r[0] for r in found} == {"", "de", "en", "bare"} and any(r[4] == 0 for r in found)
    assert sd.audit(docs.limit(0)).collect() == []


def test_top_terms_are_cut(spark):
    rows = [(" ".join(f"w{chr(97 + i)}" for i in range(20) for _ in range(1 + i * (s == "a"))), "en", s) for s in "ab"]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    found = [tuple(r) for r in sd.audit(docs, least_docs=1, top=3).collect()]
    assert sorted(found) == brute(rows, 1, 3) and sum(r[2] == "term" and r[1] == "a" for r in found) == 3
