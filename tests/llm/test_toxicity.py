"""The composed transducer against the rules read plainly; held-out quality; special rows."""

from __future__ import annotations

import random
import zlib

from pairloom.llm import toxicity as tox


def plain_matches(classes):
    """Kinds of matches in one clause, looking back from each match."""
    out = []
    for i, c in enumerate(classes):
        if c in (tox.INSULT, tox.THREAT):
            reported = tox.REPORT in classes[:i]
            negated = tox.NEGATION in classes[max(0, i - 3) : i]
            targeted = tox.TARGET in classes[max(0, i - 4) : i]
            out.append((c == tox.THREAT) * 8 + reported * 4 + negated * 2 + targeted)
    return out


def test_composition():
    dice = random.Random(2)
    for _ in range(2000):
        classes = bytes(dice.choice((0, 0, 1, 2, 3, 4, 5)) for _ in range(dice.randrange(14)))
        assert tox.clause_matches(classes) == plain_matches(classes)


def test_clauses_do_not_leak():
    grammar = tox.Grammar(insults=frozenset({"fool"}), stems=frozenset({"lowei"}))
    count = lambda text: [(k, n) for k, n in enumerate(grammar.counts(text, grammar.classes()) or []) if n]
    assert count("You. Fool") == [(0, 1)] and count("you are a fool") == [(1, 1)]
    assert count("she said you are not a FOOL, a loweist") == [(4, 1), (7, 1)]
    assert count("lowei foolish") == [] and count("I will hurt you; fool!") == [(0, 1), (8, 1)]


def test_sharper_stems_replace_blunt_ones():
    assert tox._sharpest({"abcd*": (100, 3), "abcde*": (99, 0), "xyzu*": (100, 0), "xyzuv*": (60, 0), "word*": (50, 2), "words": (49, 0)}) == {"abcde*", "xyzu*", "xyzuv*", "words"}


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = tox.held_out_scores(docs, labels).collect()
    assert len(found) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in found)
    held = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(p for _, y, p in held if not y) <= 0.005 * len(held)
    # Some texts of these tables are marked toxic without any word that tells them apart.
    assert sum(p for _, y, p in held if y) >= 0.5 * sum(y for _, y, _ in held)


def test_special_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "you fool", "c"), (3, "you fool", "c"), (None, "fool " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    grammar = tox.Grammar(insults=frozenset({"fool"}))
    found = sorted((str(r["doc_id"]), r["score"] > 0.5) for r in tox.score_texts(docs, grammar).collect())
    assert found == [("1", False), ("2", False), ("3", False), ("3", False), ("None", True)]
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert tox.learn(docs, labels).insults == frozenset()
    assert tox.held_out_scores(docs.limit(0), labels).collect() == [] and len(tox.held_out_scores(docs, labels.limit(0)).collect()) == 5


def plain_features(text):
    words = [w for w in tox._TOKEN.findall(text.lower()) if w not in tox._BREAKS]
    return tox._sample_key(words), sorted({*words} | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n})


def labelled_texts():
    """Texts of random words, a third of them with a telling word; near copies, repeated rows and keys, odd labels, nulls."""
    dice, docs, labels = random.Random(5), [], []
    words = ["".join(dice.choice("abcdeé") for _ in range(dice.randrange(2, 9))) for _ in range(60)]
    for key in range(90):
        label = 1 if key % 3 == 0 else 0
        text = [dice.choice(words) for _ in range(30)] + ["lowlife", "scumbag"][: dice.randrange(1, 3)] * label
        docs += [(key, " ".join(text)), (key + 100, " ".join([*text, dice.choice(words)])), (key + 200, " ".join([*text, "zz"]))]
        labels += [(key, label), (key + 100, label), (key + 200, label if key % 7 else None)]
    docs += [docs[0], docs[1], (3, "other text with the same key"), (None, "lowlife"), (400, None), (401, ""), (402, ""), (403, "odd lowlife"), (404, "odd one")]
    labels += [labels[0], (3, 0), (None, 1), (400, 1), (401, 1), (402, 0), (403, 2), (404, -1), (999, 1)]
    return docs, labels


def test_learned_words_match_plain_counts(spark):
    docs, labels = labelled_texts()
    picked = {}
    for key, label in labels:
        if key is not None and label is not None:
            picked[key] = max(label, picked.get(key, label))
    groups = {}
    for key, text in docs:
        if text is not None and key in picked:
            sample, features = plain_features(text)
            groups.setdefault((picked[key], sample), []).append(features)
    assert any(len({*map(tuple, g)}) > 1 for g in groups.values()) and any(len(g) == 1 for g in groups.values())
    sizes = [sum(label == x for label, _ in groups) for x in (0, 1)]
    counts = {}
    for (label, _), found in groups.items():
        for feature in min(found):
            toxic, others = counts.get(feature, (0, 0))
            counts[feature] = toxic + label, others + (label == 0)
    told = {f: c for f, c in counts.items() if c[0] >= max(4, -(-sizes[1] // 100)) and (c[0] + 0.5) * sizes[0] >= 30.0 * sizes[1] * (c[1] + 0.5)}
    names = tox._sharpest(told)
    grammar = tox.learn(*frames(spark, docs, labels))
    assert names and grammar.insults == {n for n in names if n[-1] != "*"} and grammar.stems == {n[:-1] for n in names if n[-1] == "*"}


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learning_reads_the_documents_once(spark):
    docs, labels = frames(spark, *labelled_texts())
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert tox.learn(docs.mapInArrow(counted, docs.schema), labels).insults
    assert read.value == docs.count()
