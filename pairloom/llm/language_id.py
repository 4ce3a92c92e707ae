"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams of a language, or of a document, in order. A document's
language is the one whose profile is least out of place: for each n-gram of the document's
profile, how far apart its two ranks are, or the profile's full length if the language lacks it.

N-grams are of 1 to 3 letters inside lower-case words, with a mark at both ends of each word. They
are handled as numbers, 21 bits per letter, on arrays over whole chunks of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.byte_bpe import LETTER, code_classes
from pairloom.llm.common import chunks, fold, texts
from pairloom.session import ship_package

PROFILE = 300  # n-grams in a profile
UNDETERMINED = "und"
MARK, _BITS = 1, 21  # the mark at a word's ends; bits of a code point


def grams_of_texts(values: list[str]) -> Iterator[np.ndarray]:
    """N-grams of each text, repeats included, as numbers; none for a text without a letter."""
    lowered = [v.lower() for v in values]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = code_classes()[codes] == LETTER
    # Of each run of other characters the first stays, as a mark.
    kept = np.flatnonzero(letter | np.append(True, letter[:-1]))
    marked = np.where(letter[kept], codes[kept], MARK)
    ends = np.cumsum([len(v) + 1 for v in lowered])
    begins = np.searchsorted(kept, np.append(1, ends[:-1] + 1)).tolist()
    finish = np.searchsorted(kept, ends).tolist()
    for begin, end in zip(begins, finish):
        if begin == end:
            yield np.zeros(0, np.int64)
            continue
        x = marked[begin - 1 : end + (marked[end - 1] != MARK)]
        two = (x[:-1] << _BITS) + x[1:]
        three = (two[:-1] << _BITS) + x[2:]
        yield np.concatenate((x[x != MARK], two, three[x[1:-1] != MARK]))


def train_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """Profile of every language in ``labelled``, counted over all its rows; rows without a language are left out.

    Tasks count their own chunks; counts are added up in Spark, and only the profiles themselves
    come to the driver. Ties go by the n-gram's number.
    """
    ship_package(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in chunks(batch, "text"):
                found: dict[str, list[np.ndarray]] = {}
                for language, grams in zip(rows.column("lang").to_pylist(), grams_of_texts(values)):
                    found.setdefault(language, []).append(grams)
                for language, grams in found.items():
                    gram, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    source = texts(labelled, F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL")
    totals = source.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for row in totals.withColumn("rank", rank).filter(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Ranker:
    """Compares n-grams with profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.grams = np.unique(np.array([g for grams in profiles.values() for g in grams], np.int64))
        self.place = np.full((len(self.languages), len(self.grams) + 1), PROFILE)  # a last column for n-grams of no profile
        for row, language in enumerate(self.languages):
            self.place[row, np.searchsorted(self.grams, profiles[language])] = np.arange(len(profiles[language]))

    def predict(self, grams: np.ndarray) -> tuple[str, float]:
        """Language, and how far the text is in place: 1 for equal profiles, 0 for none in common."""
        if not len(grams) or not self.languages:
            return UNDETERMINED, 0.0
        seen, counts = np.unique(grams, return_counts=True)
        if len(seen) > PROFILE:  # everything at least as frequent as the last place, ties included
            enough = counts >= np.partition(counts, -PROFILE)[-PROFILE]
            seen, counts = seen[enough], counts[enough]
        top = seen[np.argsort(-counts, kind="stable")][:PROFILE]
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        there = self.place[:, np.where(self.grams[at] == top, at, -1)]
        apart = np.where(there == PROFILE, PROFILE, np.abs(there - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(apart))
        return self.languages[best], 1.0 - float(apart[best]) / (PROFILE * len(top))


def predict_languages(docs: DataFrame, profiles: dict[str, list[int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score)`` per row: ``und`` with score 0 for null texts and texts without a letter.

    Equal distances go to the language first by name; without any profile all is ``und``.
    Repeated rows come back repeated; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(profiles)  # PROFILE n-grams per language
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(shared.value)
        for batch in batches:
            for rows, values in chunks(batch, text):
                found = [ranker.predict(grams) for grams in grams_of_texts(values)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(key), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    [key, "lang_pred", "score"],
                )

    return texts(docs, key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those outside the held-out fold."""
    profiles = train_profiles(docs.filter(fold("doc_id", 4) != 2))
    return predict_languages(docs, profiles).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
