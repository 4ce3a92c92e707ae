"""Column expressions over sentence text: the quality gate and its parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the gate.
LETTER_TOTAL = 5
NONLETTER_LIMIT = 0.65


def letter_spread_pattern(total: int = LETTER_TOTAL) -> str:
    r"""Java pattern for: on one line, ``a`` letters, something, then ``total - a`` letters.

    A line qualifies for a split exactly when its *earliest* run of ``a`` letters ends at
    least one character before its *last* run of ``total - a`` letters starts. So the search
    is anchored to line starts, and the atomic group commits to the earliest run. That keeps
    the work linear in the text, where an unanchored search is quadratic on long lines
    without a match. ``(?d)`` makes ``\n`` the only line end, also for ``.``.
    """
    splits = (rf"(?>.*?\pL{{{head}}}).+\pL{{{total - head}}}" for head in range(1, total))
    return "(?md)^(?:" + "|".join(splits) + ")"


def letter_spread(text: Column, total: int = LETTER_TOTAL) -> Column:
    """True if the letters of some line are spread over two runs as the gate asks."""
    return text.rlike(letter_spread_pattern(total))


def nonletter_count(text: Column) -> Column:
    """Number of code points that are not letters."""
    return F.length(F.regexp_replace(text, r"\pL+", ""))


def nonletter_ratio(text: Column, limit: float = NONLETTER_LIMIT) -> Column:
    """True if non-letters make up ``limit`` of the code points or more."""
    return nonletter_count(text) >= F.lit(float(limit)) * F.length(text)


def quality_ok(text: Column, total: int = LETTER_TOTAL, limit: float = NONLETTER_LIMIT) -> Column:
    """The gate as one boolean; a null text does not pass."""
    passed = letter_spread(text, total) & ~nonletter_ratio(text, limit)
    return F.coalesce(passed, F.lit(False))


def reject_reason(
    source: Column,
    target: Column | None = None,
    total: int = LETTER_TOTAL,
    limit: float = NONLETTER_LIMIT,
) -> Column:
    """Why a pair is rejected, or null if it is kept. The target is only checked for null."""
    reason = F.when(source.isNull(), "null_source")
    if target is not None:
        reason = reason.when(target.isNull(), "null_target")
    return reason.when(~letter_spread(source, total), "letter_spread").when(
        nonletter_ratio(source, limit), "nonletter_ratio"
    )


def characters(text: Column) -> Column:
    """Array of the text's code points."""
    return F.split(text, "")


def lines(text: Column) -> Column:
    r"""Array of the text's lines, parted by ``\n`` only."""
    return F.split(text, "\n")


def any_of(flags: Column) -> Column:
    """True if any element of an array of booleans is true."""
    return F.exists(flags, lambda flag: flag)


def word_tokens(text: Column) -> Column:
    """Default tokenizer: the runs of letters, in order."""
    return F.regexp_extract_all(text, F.lit(r"\pL+"), F.lit(0))


def csv_line(*columns: Column, newline: bool = True) -> Column:
    """The fully quoted CSV line of the given columns; null if any of them is null."""
    quoted = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    parts: list[Column] = []
    for field in quoted:
        parts += [F.lit(","), field] if parts else [field]
    return F.concat(*parts, F.lit("\n")) if newline else F.concat(*parts)


def map_subset(mapping: Column, keys: list[str]) -> Column:
    """The entries of a map whose key is listed, in the map's own order."""
    return F.map_filter(mapping, lambda key, _: key.isin(*keys))
