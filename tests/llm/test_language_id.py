"""Predictions against a plain rank-order comparison, and held-out accuracy."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
import regex

from pairloom.llm import language_id as lid

SF_DIR = "/root/testdata/sf0.01"


def plain_grams(text):
    """Numbers of the n-grams, word by word: 21 bits per letter, 1 for a word's ends."""
    out = Counter()
    for word in regex.findall(r"\p{L}+", (text or "").lower()):
        marked = [1, *map(ord, word), 1]
        for n in (1, 2, 3):
            for i in range(len(marked) - n + 1):
                if marked[i : i + n] != [1]:
                    out[sum(c << 21 * (n - 1 - j) for j, c in enumerate(marked[i : i + n]))] += 1
    return out


def plain_prediction(text, profiles):
    counts = plain_grams(text)
    if not counts or not profiles:
        return "und", 0.0
    top = sorted(counts, key=lambda g: (-counts[g], g))[:300]
    apart = {}
    for language, grams in profiles.items():
        place = {g: i for i, g in enumerate(grams)}
        apart[language] = sum(abs(i - place[g]) if g in place else 300 for i, g in enumerate(top))
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (300 * len(top))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_profiles_and_predictions(docs):
    profiles = lid.train_profiles(docs.filter("doc_id < 200"))
    counts: dict = {}
    for row in docs.filter("doc_id < 200").collect():
        counts.setdefault(row["lang"], Counter()).update(plain_grams(row["text"]))
    assert profiles == {k: sorted(c, key=lambda g: (-c[g], g))[:300] for k, c in counts.items()}
    some = docs.filter("doc_id BETWEEN 300 AND 360")
    found = {r["doc_id"]: (r["lang_pred"], pytest.approx(r["score"])) for r in lid.predict_languages(some, profiles).collect()}
    assert found == {r["doc_id"]: plain_prediction(r["text"], profiles) for r in some.collect()}


def test_held_out_accuracy(docs):
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = lid.held_out_languages(docs).collect()
    assert len(found) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_special_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    learned = [(1, "the other that", "en", "x"), (2, "der die das", "de", "x"), (3, "le la les", None, "x"), (None, None, "fr", None)]
    profiles = lid.train_profiles(spark.createDataFrame(learned, schema))
    assert set(profiles) == {"en", "de"}
    rows = [(1, None, None, None), (2, "", None, None), (3, "12 !?", None, None), (4, "the", None, None), (4, "the", None, None), (None, "der " * 50_000, None, None)]
    found = sorted((str(r[0]), r[1], r[2] > 0) for r in lid.predict_languages(spark.createDataFrame(rows, schema), profiles).collect())
    assert found == [("1", "und", False), ("2", "und", False), ("3", "und", False), ("4", "en", True), ("4", "en", True), ("None", "de", True)]
    empty = spark.createDataFrame([], schema)
    assert lid.held_out_languages(empty).collect() == [] and lid.train_profiles(empty) == {}
    assert lid.predict_languages(spark.createDataFrame(rows[3:4], schema), {}).first()["lang_pred"] == "und"
