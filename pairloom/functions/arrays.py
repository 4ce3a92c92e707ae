"""Column expressions over token and vector arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_to(ids: Column, length: Column, pad_id: int) -> Column:
    """``ids`` filled up with ``pad_id`` on the right."""
    return F.concat(ids, F.array_repeat(F.lit(pad_id), length - F.size(ids)))


def attention_mask(ids: Column, length: Column) -> Column:
    """1 for each id of the unpadded array, 0 for padding up to ``length``."""
    return F.concat(
        F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), length - F.size(ids))
    )


def special_tokens_mask(ids: Column, special_ids: Sequence[int]) -> Column:
    """1 where the id is one of the special ids, else 0."""
    return F.transform(ids, lambda x: x.isin(*special_ids).cast("int"))


def compress(values: Column, mask: Column) -> Column:
    """The values whose mask is 0; works for ids and for vectors alike.

    The arrays are zipped first: an array that a lambda looks into would be computed again for
    every element.
    """
    entries = F.arrays_zip(values.alias("value"), mask.alias("mask"))
    kept = F.filter(entries, lambda entry: entry["mask"] == 0)
    return F.transform(kept, lambda entry: entry["value"])


def from_end(values: Column, back: int = 1) -> Column:
    """Element counted from the end, 1 being the last; null if there is none."""
    return F.try_element_at(values, F.lit(-back))


def at(values: Column, index: Column | int) -> Column:
    """Element at a 0-based index; null if there is none."""
    return F.get(values, index if isinstance(index, Column) else F.lit(index))


def in_order(pos: Column | Sequence[Column], value: Column) -> Column:
    """Aggregate: the group's values as one array, ordered by position: one column, or several that make it up
    and are null together.

    Positions and values are gathered in lists of their own, in the same order, which take far less in a
    shuffle than a list of pairs. Such a list has no nulls, so positions of nulls are in others.
    """
    parts = [pos] if isinstance(pos, Column) else list(pos)

    def placed(which: Column, values: Column) -> Column:
        lists = [F.collect_list(F.when(which, part)).alias(f"p{i}") for i, part in enumerate(parts)]
        return F.arrays_zip(*lists, values.alias("v"))

    values = F.collect_list(F.when(parts[0].isNotNull(), value))
    nothing = F.filter(values, lambda _: F.lit(False))
    gathered = F.concat(placed(value.isNotNull(), values), placed(value.isNull(), nothing))
    return F.transform(F.sort_array(gathered), lambda entry: entry["v"])


def shifted_entries(states: Column, ids: Column) -> Column:
    """Array of ``(pos, key, value, key token)``: the state before a token, that token, and the one
    before it, whose state it is.

    States are those after reading each token, so the key of the token at ``pos`` (0-based)
    is the state at ``pos - 1``; the first token has none. One row holds the whole sequence,
    so no window or shuffle is needed.
    """
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    entries = F.arrays_zip(
        F.slice(states, F.lit(1), n).alias("key_vector"),
        F.slice(ids, F.lit(2), n).alias("value_token_id"),
        F.slice(ids, F.lit(1), n).alias("key_token_id"),
    )
    return F.transform(
        entries,
        lambda entry, i: F.struct((i + 1).alias("pos"), entry["key_vector"], entry["value_token_id"], entry["key_token_id"]),
    )
