"""Merge semantics of the store: the current row of a key, distinct links, resolved link ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, version: str, columns: dict[str, object]) -> DataFrame:
    """One row per key, from the row with the greatest version: ``key`` and the given columns (name -> expression).

    An aggregate with partial aggregation instead of a window: a key that was sent a million times leaves each
    task as one row. Rows with a null key drop out; a row with a null version is older than any other; rows of
    equal version should be identical.
    """
    fields = F.struct(*[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()])
    oldest = F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))
    at = F.coalesce(F.col(version), oldest) if df.schema[version].dataType.simpleString().startswith("timestamp") else F.col(version)
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(fields, at).alias("__row"))
    return picked.select(key, *[F.col("__row")[n].alias(n) for n in columns])
