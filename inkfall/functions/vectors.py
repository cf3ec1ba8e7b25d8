"""Vector functions on arrays, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfall.functions.lazy import bound
from inkfall.functions.text import col


def dot(a, b) -> Column:
    product = F.zip_with(col(a).cast("array<double>"), col(b).cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 for vectors of different lengths and for zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(col(a)) != F.size(col(b))) | (n == 0), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), n))


def normalized(a) -> Column:
    """Of length one; a zero vector stays as it is."""
    return bound(col(a).cast("array<double>"), lambda v: bound(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def word_spots(words: DataFrame, dim: int, word: str = "word") -> DataFrame:
    """pos, value in place of a word: the three places and values that it adds to a hashed embedding, of its MD5 number h
    at (h + 7919 j) mod dim the j-th byte of h over 255, less a half.

    The number is taken 32 bits at a time, in steps of plain columns that compile.
    """
    keep = [c for c in words.columns if c != word]
    digits = words.select(*keep, F.md5(word).alias("digits"))
    parts = digits.select(*keep, *[F.conv(F.substring("digits", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"part{i}") for i in range(4)])
    h = F.lit(0).cast("long")
    for i in range(4):
        h = (h * ((1 << 32) % dim) + F.col(f"part{i}")) % dim
    byte = lambda j: F.shiftright("part3", 8 * j).bitwiseAND(F.lit(255).cast("long"))
    spot = lambda j: F.struct(((F.col("h") + j * 7919) % dim).cast("int").alias("pos"), (byte(j).cast("double") / 255.0 - 0.5).alias("value"))
    return parts.select(*keep, "part3", h.alias("h")).select(*keep, F.inline(F.array(*[spot(j) for j in range(3)])))
