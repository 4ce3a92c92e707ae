"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes: insult, threat, target, negation, reporting verb, other. Small transducers
run over a clause's classes, each keeping track of one thing: whether what follows is reported
speech, whether a negation is near, whether a target is near. Their composition is one transducer
whose states are the combinations; where it reads an insult or a threat it emits a match of one
kind out of sixteen (what, and in which of the contexts). A document's score is the logistic of
the weighted logarithms of its counts of matches; isolated words of other classes add nothing.

The insult lexicon and the weights are learned from labelled texts; the closed classes are fixed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import chunks, fold, texts
from pairloom.scratch import write_scratch
from pairloom.session import ship_package

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)

# Closed word classes in English, German, French and Spanish.
TARGETS = (
    "you your he him his she her they them their these those people everyone du dich dir dein deine ihr euch euer er ihn sie "
    "ihnen tu te toi ton ta vous votre il elle ils elles leur tú ti usted ustedes su él ella ellos ellas vosotros"
).split()
NEGATIONS = "not no never none neither nor isn aren wasn don doesn nicht kein keine keinen nie niemals ne pas jamais aucun aucune non nunca ningún ninguna jamás".split()
REPORTS = (
    "said says say saying called calls wrote writes quoted claims claimed reported told sagte sagt schrieb nannte behauptet "
    "zitiert dit disait écrit appelle déclare dijo dice escribió llamó afirma"
).split()
THREATS = "kill hurt destroy beat stab shoot burn murder töten umbringen schlagen verletzen tuer frapper détruire matar golpear destruir".split()

LABELLED_ROWS = 40_000  # at most so many labelled rows are learned from, picked by a hash of their key
_STEMS = (4, 5, 6)
_TOKEN = regex.compile(r"\p{L}+|[.!?;:\n\"“”«»]")
_BREAKS = frozenset(".!?;:\n\"“”«»")

# ---------------------------------------------------------------- transducers


@dataclass(frozen=True)
class Transducer:
    """States from 0; ``step(state, class)`` is the next state; ``flag(state)`` is what a match is marked with."""

    states: int
    step: Callable[[int, int], int]
    flag: Callable[[int], int]


def near(trigger: int, reach: int) -> Transducer:
    """Flags the ``reach`` words after a trigger."""
    return Transducer(reach + 1, lambda s, c: reach if c == trigger else 0 if c == BREAK else max(0, s - 1), lambda s: int(s > 0))


def onward(trigger: int) -> Transducer:
    """Flags everything after a trigger, to the end of the clause."""
    return Transducer(2, lambda s, c: 1 if c == trigger else 0 if c == BREAK else s, lambda s: s)


def compose(parts: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """Next state and joint flags of all parts run side by side: tables over (state, class) and state."""
    states = list(product(*(range(p.states) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    step = np.array([[number[tuple(p.step(x, c) for p, x in zip(parts, s))] for c in range(7)] for s in states], np.int16)
    flags = np.array([reduce(lambda n, bit: 2 * n + bit, (p.flag(x) for p, x in zip(parts, s)), 0) for s in states], np.int16)
    return step, flags


_STEP, _FLAGS = (t.tolist() for t in compose([onward(REPORT), near(NEGATION, 3), near(TARGET, 4)]))
KINDS = 16  # insult or threat, reported or not, negated or not, targeted or not


def clause_matches(classes: bytes) -> list[int]:
    """Kinds of the matches in a row of classes."""
    out, state = [], 0
    for c in classes:
        if c == INSULT or c == THREAT:
            out.append((c - INSULT) * 8 + _FLAGS[state])
        state = _STEP[state][c]
    return out


# ---------------------------------------------------------------- the model


class _Classes(dict):
    """Class of a word, remembered within bounds."""

    MOST = 300_000

    def __init__(self, insults: frozenset[str], stems: frozenset[str]):
        super().__init__()
        self.insults, self.stems = insults, stems
        self.closed = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}

    def __missing__(self, word: str) -> int:
        if len(self) > self.MOST:
            self.clear()
        if word in _BREAKS:
            found = BREAK
        elif word in self.insults or any(word[:n] in self.stems for n in _STEMS if len(word) > n):
            found = INSULT
        else:
            found = self.closed.get(word, OTHER)
        if len(word) <= 64:
            self[word] = found
        return found


@dataclass
class Grammar:
    """Learned lexicon and weights; without anything learned, every match counts alike."""

    insults: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.full(KINDS, 2.0))
    bias: float = -4.0

    def counts(self, text: str, classes: _Classes) -> list[int] | None:
        """Number of matches of each kind; None if there is none."""
        row = bytes(map(classes.__getitem__, _TOKEN.findall(text.lower())))
        if INSULT not in row and THREAT not in row:
            return None
        found = [0] * KINDS
        for clause in row.split(bytes([BREAK])):
            if INSULT in clause or THREAT in clause:
                for kind in clause_matches(clause):
                    found[kind] += 1
        return found

    def score(self, text: str, classes: _Classes) -> float:
        found = self.counts(text, classes)
        total = self.bias + (float(self.weights @ np.log1p(found)) if found else 0.0)
        return float(1 / (1 + np.exp(-min(max(total, -500.0), 500.0))))

    def classes(self) -> _Classes:
        return _Classes(self.insults, self.stems)


def _words(text: str) -> list[str]:
    return [w for w in _TOKEN.findall(text.lower()) if w not in _BREAKS]


def _sample_key(words: list[str]) -> int:
    """Near copies mostly share this: the least hash of three words in a row."""
    return min((hash_of(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) >> 1


def _sharpest(counts: dict[str, tuple[int, int]]) -> set[str]:
    """Features without the stems that a longer stem or a word does as well with less error.

    ``counts``: in how many toxic and other texts each feature is; a stem ends with an asterisk.
    """
    kept = set(counts)
    for name, (toxic, others) in counts.items():
        for n in _STEMS:
            shorter = name[:n] + "*"
            if shorter != name and shorter in counts and toxic >= 0.95 * counts[shorter][0] and others < counts[shorter][1]:
                kept.discard(shorter)
    return kept


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = LABELLED_ROWS) -> Grammar:
    """Learn from labelled documents: at most ``rows`` of them, picked by a hash of the key.

    The picked keys are few enough to broadcast, so no text is shuffled. The documents are read once: the picked
    ones are written with their sample keys. Near copies count once; only texts that share a sample key and a label
    send their features to be compared, and only features that enough toxic texts have are counted in the
    others. A word, or a stem of 4 to 6 letters, is an insult if at least 1 % of the
    toxic texts have it (4 at least) and it is 30 times as common in them as in the others; of a stem
    and a longer one that serves as well, the one with fewer errors stays.
    Rows without a key, text or label are left out; without toxic and other rows nothing is learned.
    """
    spark = docs.sparkSession
    ship_package(spark)
    picked = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .filter("key IS NOT NULL AND label IS NOT NULL")
        .groupBy("key")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(rows)
    )
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL").join(F.broadcast(picked), "key")

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, values in chunks(batch, "text"):
                keys = [_sample_key(_words(value)) for value in values]
                yield pa.RecordBatch.from_arrays([chunk.column("label"), pa.array(keys, pa.int64()), chunk.column("text")], ["label", "sample", "text"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, values in chunks(batch, "text"):
                out = []
                for value in values:
                    seen = set(_words(value))
                    out.append(sorted(seen | {w[:n] + "*" for w in seen for n in _STEMS if len(w) > n}))
                yield pa.RecordBatch.from_arrays([chunk.column("label"), chunk.column("sample"), pa.array(out, pa.list_(pa.string()))], ["label", "sample", "features"])

    picked_texts = write_scratch(labelled.mapInArrow(samples, "label int, sample long, text string"), "labelled")
    groups = picked_texts.groupBy("label", "sample").agg(F.count("*").alias("n"))
    sizes = {r["label"]: r["n"] for r in groups.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, others = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not others:
        return Grammar()
    # Written, so that Spark knows its size and broadcasts it only if it is small; so are the frequent features.
    shared = write_scratch(groups.filter("n > 1").select("label", "sample"), "shared-samples")

    def marked(rows: DataFrame) -> DataFrame:
        """A row for each feature of each text, near copies taken once."""
        alone, copies = (
            rows.join(shared, ["label", "sample"], how).mapInArrow(features, "label int, sample long, features array<string>")
            for how in ("left_anti", "left_semi")
        )
        once = alone.unionByName(copies.groupBy("label", "sample").agg(F.min("features").alias("features")))
        return once.select("label", F.explode("features").alias("feature"))

    least = max(4, -(-toxic // 100))
    frequent = marked(picked_texts.filter("label <> 0")).groupBy("feature").agg(F.sum("label").alias("toxic")).filter(F.col("toxic") >= least)
    told = (
        marked(picked_texts)
        .join(write_scratch(frequent.select("feature"), "frequent-features"), "feature")
        .groupBy("feature")
        .agg(F.sum("label").alias("toxic"), F.count_if(F.col("label") == 0).alias("others"))
        .filter((F.col("toxic") + 0.5) * others >= 30.0 * toxic * (F.col("others") + 0.5))
        .collect()  # at most 100 per word of a text, since each is in a hundredth of the texts
    )
    names = _sharpest({r["feature"]: (r["toxic"], r["others"]) for r in told})
    grammar = Grammar(frozenset(n for n in names if n[-1] != "*"), frozenset(n[:-1] for n in names if n[-1] == "*"))

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = grammar.classes()
        for batch in batches:
            found = [grammar.counts(x.as_py() or "", classes) or [0] * KINDS for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int64()))], ["label", "kinds"])

    # One row of 16 counts for each of the picked texts.
    table = picked_texts.select("label", "text").mapInArrow(matches, "label int, kinds array<long>").groupBy("label", "kinds").count().orderBy("label", "kinds").collect()
    x = np.log1p(np.array([r["kinds"] for r in table], float))
    y = np.array([r["label"] for r in table], float)
    grammar.weights, grammar.bias = fit(x, y, np.array([r["count"] for r in table], float))
    return grammar


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with repeated rows, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.append(np.ones(len(w) - 1), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + keep * w
        curve = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(keep)
        move = np.linalg.solve(curve, slope)
        w -= move * min(1.0, 5.0 / max(1e-12, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score_texts(docs: DataFrame, grammar: Grammar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of each whole text.

    A null text is empty; an empty text scores as one without a match. Columns of these two names
    are replaced; all others stay, and repeated rows stay repeated.
    """
    ship_package(docs.sparkSession)
    kept = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = grammar.classes()
        for batch in batches:
            scores = [grammar.score(x.as_py() or "", classes) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                [*batch.schema.names, "score", "predicted"],
            )

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return texts(kept, *(f"`{c}`" for c in kept.columns)).mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learned from labels outside the held-out fold."""
    grammar = learn(docs, labels.filter(fold("doc_id", 5) != 0))
    return score_texts(docs.select("doc_id", "text"), grammar).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
