"""Embeddings as integer vectors, shared by the operators on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Squared distances and inner products stay below 2 ** SAFE_BITS, so that four of them fit 64 bits.
SAFE_BITS = 60


def finite(c):
    """Whether an array is there and holds neither null nor NaN nor infinity; an empty one does."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(c, bad), F.lit(False))


def usual_length(rows: DataFrame, column: str, multiple_of: int = 1) -> int:
    """The most frequent length of finite arrays that is a positive multiple of so many, the longer one of equals; 0 if there is none."""
    n = F.size(column)
    best = rows.where(finite(F.col(column)) & (n > 0) & (n % multiple_of == 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return best["n"] if best else 0


def integers(c, length: int, scale: int = SCALE):
    """floor(scale * x) of each component as int; those beyond limit(length) are set to it."""
    most = float(limit(length))
    return F.transform(c, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-most)), F.lit(most))).cast("int"))


def limit(length: int) -> int:
    """The largest component for which length * (2 * limit) ** 2 stays within SAFE_BITS."""
    return min(int((2**SAFE_BITS / max(1, length)) ** 0.5) // 2, 2**30)


def matrix(column, length: int):
    """An Arrow list column of equally long lists without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)
