"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets of the hash embedding (fixed value).
DIMENSIONS = 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def similarity(a: Column, b: Column) -> Column:
    """Dot product to 6 digits; 0 where a vector is null, empty or holds a null or NaN, or the lengths differ."""
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fits, F.coalesce(F.nanvl(F.round(dot(a, b), 6), F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def bucket(token: Column) -> Column:
    """A token's bucket: the first 32 bits of its MD5 digest modulo the number of buckets."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(DIMENSIONS)).cast("int")


def hash_embedding(tokens: Column) -> Column:
    """Counts of the tokens' buckets, scaled to unit length and rounded to 6 digits; all 0 without tokens."""
    unit = lambda v, n: F.transform(v, lambda x: F.when(n > 0, F.round(x / n, 6)).otherwise(F.lit(0.0)))
    # as the end of one fold, so that the counts are made once and not again for each of their uses
    return F.aggregate(
        F.transform(tokens, bucket),
        F.array_repeat(F.lit(0.0), DIMENSIONS),
        lambda acc, b: F.transform(acc, lambda x, i: F.when(i == b, x + 1.0).otherwise(x)),
        lambda acc: unit(acc, F.sqrt(F.aggregate(acc, F.lit(0.0), lambda s, x: s + x * x))),
    )
