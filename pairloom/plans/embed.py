"""The embedding job: batch pairs, tokenize both sides, score them, build the datastore."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import arrays as ar
from pairloom.functions.text import word_tokens
from pairloom.operators.alignment import align
from pairloom.operators.batching import BATCH_SIZE, assign_batches, pad_batches
from pairloom.operators.datastore import datastore_entries
from pairloom.operators.ledger import run_parts
from pairloom.operators.scoring import PairModel, score_pairs
from pairloom.operators.tokens import (
    END,
    PAD,
    UNKNOWN,
    Tokenizer,
    Vocabulary,
    build_vocabulary,
    decode_sides,
    encode_sides,
    tokenize_pair,
)
from pairloom.scratch import write_scratch
from pairloom.sources.vector_tables import write_grouped


@dataclass(frozen=True)
class EncodedPairs:
    """Pairs with ``source_tokens``, ``target_tokens``, ``source_ids`` and ``target_ids``."""

    table: DataFrame
    vocabulary: Vocabulary


def encode_pairs(
    pairs: DataFrame,
    source: str = "source",
    target: str = "target",
    source_lang: str = "<src>",
    target_lang: str = "<tgt>",
    source_tokenizer: Tokenizer = word_tokens,
    target_tokenizer: Tokenizer = word_tokens,
    vocabulary: Vocabulary | None = None,
    shared: bool | None = None,
) -> EncodedPairs:
    """Token ids of both sides: language code, tokens, end mark.

    Without a vocabulary one is built from both sides of these pairs, whose tokens are then
    written: the pairs are worked out and tokenized once, for the vocabulary and for the ids.
    """
    tokenized = tokenize_pair(pairs, source, target, source_tokenizer, target_tokenizer)
    if vocabulary is None:
        # With a number for each row, by which a large vocabulary's ids come back without another write.
        tokenized = write_scratch(tokenized.withColumn("__row", F.monotonically_increasing_id()), "tokenized")
        reserved = (PAD, END, UNKNOWN, source_lang, target_lang)
        vocabulary = build_vocabulary(tokenized, "source_tokens", "target_tokens", reserved=reserved)
    encoded = encode_sides(tokenized, {"source_tokens": "source_ids", "target_tokens": "target_ids"}, vocabulary, shared).drop("__row")
    end = F.array(F.lit(vocabulary.reserved_id(END)))
    for side, lang in (("source", source_lang), ("target", target_lang)):
        lead = F.array(F.lit(vocabulary.reserved_id(lang)))
        encoded = encoded.withColumn(f"{side}_ids", F.concat(lead, f"{side}_ids", end))
    return EncodedPairs(encoded, vocabulary)


def collate_pairs(
    encoded: EncodedPairs, *order_by: str, size: int = BATCH_SIZE, unique: bool = False
) -> DataFrame:
    """Encoded pairs in batches, both sides padded to the longest of their batch."""
    pad = encoded.vocabulary.reserved_id(PAD)
    batched = assign_batches(encoded.table, *order_by, size=size, unique=unique)
    return pad_batches(batched, {"source_ids": pad, "target_ids": pad})


def embed_pairs(
    encoded: EncodedPairs,
    key: str | Sequence[str],
    make_model: Callable[[], PairModel],
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """One vector per source and target id, and the token strings, next to their pair's key.

    Scoring needs no numbering: a pair's vectors do not depend on its batch. So this is one
    narrow stage after encoding. Only the key and the ids go to the model's workers; token strings
    come from the ids afterwards. If the vocabulary is too large for that, strings are joined to the ids first,
    as states are much longer, and should be neither written nor shuffled.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows, sides = encoded.table.select(*keys, "source_ids", "target_ids"), {"source_ids": "source_tokens", "target_ids": "target_tokens"}
    if encoded.vocabulary.fits_in_workers:
        return decode_sides(score_pairs(rows, "source_ids", "target_ids", make_model, batch_size), sides, encoded.vocabulary)
    done = score_pairs(decode_sides(rows, sides, encoded.vocabulary), "source_ids", "target_ids", make_model, batch_size)
    return done.select(*rows.columns, "source_states", "target_states", *sides.values())


def embed_in_parts(
    encoded: EncodedPairs,
    key: str | Sequence[str],
    make_model: Callable[[], PairModel],
    path: str,
    n_parts: int = 64,
    at_a_time: int = 8,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """The states of ``embed_pairs``, written to ``path`` part by part: a run after a failure goes on with
    the parts that are not finished. The vocabulary must be the same for both runs (keep it, see
    ``vocabularies``)."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = encoded.table.select(*keys, "source_ids", "target_ids")
    return run_parts(rows, keys, lambda part: score_pairs(part, "source_ids", "target_ids", make_model, batch_size), path, n_parts, at_a_time)


def build_datastore(
    encoded: EncodedPairs,
    key: str | Sequence[str],
    make_model: Callable[[], PairModel],
    group_ids: str | None = None,
    path: str | None = None,
    n_buckets: int = 64,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Datastore rows ``(group_token_id, key, pos, key_vector, value_token_id)``.

    ``group_ids`` names an array column of the encoded table that files each target position
    under a source token; ``align_pairs`` learns one. Without one, positions are matched by number. Given a path, the
    store is written by group and read back; else it is kept as a scratch table, as scoring
    must not run again for each use.
    """
    keys = [key] if isinstance(key, str) else list(key)
    needed = [*keys, "source_ids", "target_ids"]  # texts stay out of the model's workers
    scored = score_pairs(encoded.table.select(*needed, *([group_ids] if group_ids else [])), "source_ids", "target_ids", make_model, batch_size)
    if group_ids is None:
        group_ids = "__group_ids"
        scored = scored.withColumn(group_ids, same_position_groups("source_ids", "target_ids"))
    entries = datastore_entries(scored, keys, group_ids, "target_ids", "target_states", encoded.vocabulary.special_ids)
    if path is None:
        return write_scratch(entries, "datastore")
    write_grouped(entries, path, "group_token_id", n_buckets)
    return entries.sparkSession.read.parquet(path).drop("n_buckets", "bucket")


def align_pairs(encoded: EncodedPairs, rounds: int = 5, name: str = "group_ids") -> EncodedPairs:
    """Encoded pairs with the source token that each target position belongs to, learned from all
    pairs: a column of groups for ``build_datastore``. Special ids take no part; an unknown token does."""
    aligned = align(encoded.table, "source_ids", "target_ids", encoded.vocabulary.special_ids, rounds, name=name)
    return EncodedPairs(write_scratch(aligned.table, "aligned"), encoded.vocabulary)


def same_position_groups(source_ids: str, target_ids: str):
    """For each target position the source id at the same position, or the last one there is."""
    n_source, n_target = F.size(source_ids), F.size(target_ids)
    return F.concat(
        F.slice(F.col(source_ids), F.lit(1), n_target),
        F.array_repeat(ar.from_end(F.col(source_ids)), n_target - n_source),
    )
