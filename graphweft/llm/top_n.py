"""Top N items within every group by secondary sort and streamed Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it (first row left out); nulls equal each other."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    other = pc.xor(pc.is_null(a), pc.is_null(b))
    return pc.fill_null(pc.or_kleene(pc.not_equal(a, b), other), False).to_numpy(zero_copy_only=False)


def first_n(keys: list[str], n: int, rank: str | None = None):
    """A function for ``mapInArrow``: of rows sorted by ``keys``, the first ``n`` rows of each run of equal keys.

    It holds one batch and the last key, whatever the size of a group. ``rank`` names a column for the place
    within the run, counted from 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            starts = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                starts[1:] |= _changes(c)
            begin = np.where(starts, np.arange(batch.num_rows), 0)
            place = np.arange(batch.num_rows) - np.maximum.accumulate(begin)
            if last == [c[0].as_py() for c in columns]:
                head = np.argmax(starts) if starts.any() else batch.num_rows
                place[:head] += count
            last, count = [c[-1].as_py() for c in columns], int(place[-1]) + 1
            kept = batch.filter(pa.array(place < n))
            if kept.num_rows:
                if rank:
                    kept = pa.RecordBatch.from_arrays([*kept.columns, pa.array(place[place < n] + 1, pa.int32())], [*kept.schema.names, rank])
                yield kept

    return run


def top_n_per_group(df: DataFrame, groups: list[str], score: str, item: str, n: int = 10) -> DataFrame:
    """The ``n`` best items of every group: the group columns, ``item``, ``score`` and ``rank`` (from 1).

    An item's score is the highest one that it has in its group; order is score descending, then item descending
    by code point, so equal scores come out the same way every time. Null and NaN scores are no scores, and
    items without a score or with a null name drop out; a null group is a group. Repeated rows change nothing,
    an empty table gives an empty result, other columns are ignored whatever their names.

    The rows are first reduced to one per item (partial aggregation before the shuffle), which spreads a hot
    group over all partitions by its items. Each partition then streams its own first ``n`` per group, so at
    most ``n`` rows per group and partition meet in the last shuffle.
    """
    g = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(groups, g, strict=True)], F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    best = rows.where(F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")).groupBy(*g, "item").agg(F.max("score").alias("score"))
    order = [*[F.col(c).asc() for c in g], F.col("score").desc(), F.col("item").desc()]
    local = best.sortWithinPartitions(*order).mapInArrow(first_n(g, n), best.schema)
    merged = local.repartition(*g).sortWithinPartitions(*order)
    schema = T.StructType([*best.schema.fields, T.StructField("rank", T.IntegerType())])
    return merged.mapInArrow(first_n(g, n, "rank"), schema).select(*[F.col(a).alias(c) for c, a in zip(groups, g, strict=True)], F.col("item").alias(item), F.col("score").alias(score), "rank")
