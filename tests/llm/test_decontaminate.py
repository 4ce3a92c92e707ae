"""Contained items against brute force, at the edge of the threshold too."""

from __future__ import annotations

import random
import re

from pairloom.llm import decontaminate as dec


def brute(docs, items, width=5, share=0.8):
    def sets(rows, widths):
        out = {}
        for key, text in rows:
            w = re.findall(r"[^\W_]+", (text or "").lower())
            if key is not None:
                for n in widths(w):
                    out.setdefault(key, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return out

    i = sets(items, lambda w: [min(width, len(w))] if w else [])
    occurring = {min(width, len(re.findall(r"[^\W_]+", (t or "").lower()))) for _, t in items} - {0}
    d = sets(docs, lambda w: [n for n in occurring if n <= len(w)])
    return sorted(
        (a, b, len(i[b]), len(d[a] & i[b])) for a in d for b in i if i[b] and len(d[a] & i[b]) >= share * len(i[b]) - 1e-9
    )


def test_same_as_brute_force(spark, monkeypatch):
    dice = random.Random(9)
    vocabulary = ["w%d" % i for i in range(40)] + ["É", "Größe"]
    items = [(i, " ".join(dice.choices(vocabulary, k=dice.choice((1, 3, 5, 9, 14, 25, 60))))) for i in range(40)]
    docs = []
    for i in range(150):
        words = dice.choices(vocabulary, k=dice.choice((0, 3, 50, 400)))
        for _ in range(dice.randrange(3)):
            own = dice.choice(items)[1].split()
            for _ in range(dice.choice((0, 0, 1, 2))):
                own[dice.randrange(len(own))] = "edited"
            at = dice.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((i, dice.choice((" ", ", ", "\n")).join(words).title()))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, items[1][1]), (502, items[1][1]), (503, items[0][1])]
    items += [(90, None), (91, "?!"), (None, "w1 w2 w3 w4 w5"), (items[5][0], items[5][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    wanted = brute(docs, items)
    assert sorted(map(tuple, dec.contained_items(d, i).collect())) == wanted and len(wanted) > 60
    monkeypatch.setattr(dec, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, dec.contained_items(d, i).collect())) == wanted
    leaky = {w[0] for w in wanted}
    lost = {t for k, t in docs if k is None and brute([(0, t)], items)}
    kept = sorted(str(k) for k, t in docs if k not in leaky and not (k is None and t in lost))
    assert sorted(str(r["doc_id"]) for r in dec.without_leaks(d, i).collect()) == kept and "None" not in kept
    assert dec.contained_items(d.limit(0), i).collect() == [] and dec.contained_items(d, i.limit(0)).collect() == []


def test_short_items_are_found_inside_documents(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox, jumps over"), (2, "brown jumps fox"), (3, "fox"), (4, "a fox jumps")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Brown fox jumps"), (2, "fox"), (3, "quick brown fox jumps over"), (4, "over the")], "item_id long, text string")
    assert sorted(map(tuple, dec.contained_items(docs, items).collect())) == [(1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 1), (2, 2, 1, 1), (3, 2, 1, 1), (4, 2, 1, 1)]


def test_a_very_long_document(spark):
    dice = random.Random(2)
    filler = " ".join("w%d" % dice.randrange(10**6) for _ in range(100_000))
    item = " ".join("w%d" % dice.randrange(10**6) for _ in range(30))
    docs = spark.createDataFrame([(1, f"{filler} {item} {filler}"), (2, filler)], "doc_id long, text string")
    found = dec.contained_items(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [tuple(r) for r in found] == [(1, 7, 26, 26)]
