"""Column expressions over vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(vector: Column) -> Column:
    """Euclidean length, summed in double."""
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalize(vector: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is.

    The norm sits in a one-element array so that it is evaluated once per vector and not once
    per element.
    """
    scaled = F.transform(
        F.array(l2_norm(vector)),
        lambda norm: F.when(
            norm > 0, F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))
        ).otherwise(F.transform(vector, lambda x: x.cast("float"))),
    )
    return F.get(scaled, F.lit(0))


def has_dimension(vector: Column, dimension: int) -> Column:
    """True for a vector of exactly this many elements, none of them null."""
    return F.coalesce(
        (F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False)
    )


def squared_l2(left: Column, right: Column) -> Column:
    """Squared distance of two vectors, summed in double."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") - b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x * x,
    )
