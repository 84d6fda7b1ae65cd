"""Filling fixed-capacity containers with items: optimal length buckets and token-budget batches.

Dynamic programming over the global length histogram chooses the bucket boundaries that minimise padding. From
the buckets' sizes a plan is made of runs of equal containers: a batch of as many items of one bucket as the
budget takes, and what is left of the budget goes to the next smaller buckets with items left. The plan is as
large as the buckets allow, however many items there are; each item finds its container from its rank in its
bucket alone, so nothing but the histogram is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import written

#: Buckets at most; more buckets pad less and make the plan longer.
BUCKETS = 256
#: Items (about) that are ranked in one part: a length that many items have is split into as many parts as that takes.
PER_PART = 50_000


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets with the least padding of all items to their bucket's bound.

    ``lengths`` ascending and distinct. The last bucket of the first j lengths begins after i lengths; the best i
    never falls as j grows, so each layer is solved for ever finer steps of j between the neighbours' best i.
    """
    n = len(lengths)
    if n <= buckets:
        return lengths
    bound = np.concatenate(([0.0], lengths))
    items = np.concatenate(([0.0], np.cumsum(counts, dtype=np.float64)))
    tokens = np.concatenate(([0.0], np.cumsum(lengths * counts.astype(np.float64))))
    best = bound * items - tokens
    choice = np.zeros((buckets + 1, n + 1), dtype=np.int32)
    for k in range(2, buckets + 1):
        new, opt = np.zeros(n + 1), choice[k]
        step = 1 << n.bit_length()
        while step:
            j = np.arange(step, n + 1, 2 * step)
            if len(j):
                low = opt[j - step]
                high = np.minimum(np.where(j + step <= n, opt[np.minimum(j + step, n)], n), j - 1)
                width = high - low + 1
                at = np.cumsum(width) - width
                i = np.arange(width.sum()) - np.repeat(at - low, width)
                to = np.repeat(j, width)
                cost = best[i] + bound[to] * (items[to] - items[i]) - (tokens[to] - tokens[i])
                new[j] = np.minimum.reduceat(cost, at)
                hit = np.flatnonzero(cost == np.repeat(new[j], width))
                owner = np.repeat(np.arange(len(j)), width)[hit]
                first = np.r_[True, owner[1:] != owner[:-1]]
                opt[j] = i[hit[first]]
            step //= 2
        best = new
    out, j = [], n
    for k in range(buckets, 0, -1):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(choice[k, j])
    return np.array(out[::-1])


def container_plan(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (bucket, first rank, containers, first container, items per container) and the number of containers.

    Largest bucket first. A run of equal containers ends where one of its buckets runs out, so there are about as
    many runs as there are pairs of a bucket and a batch that it is part of.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros(len(bounds), dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    containers = 0
    top = len(bounds) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        room, batch, b = capacity, [], top
        while b >= 0 and room >= bounds[0]:
            b = min(b, int(np.searchsorted(bounds, room, "right")) - 1)
            while b >= 0 and not left[b]:
                b -= 1
            if b < 0:
                break
            take = int(min(left[b], room // bounds[b]))
            batch.append((b, take))
            room -= take * int(bounds[b])
            b -= 1
        times = max(1, min(int(left[b] // take) for b, take in batch))
        for b, take in batch:
            runs.append((b, int(used[b]), times, containers, take))
            used[b] += times * take
            left[b] -= times * take
        containers += times
    return runs, containers


def pack(items: DataFrame, packs: DataFrame, *, id_col: str, size_col: str, pack_col: str, capacity_col: str, buckets: int = BUCKETS, per_part: int = PER_PART) -> DataFrame:
    """Assign every item to a container of each capacity: ``pack, id, piece, start, size, container``.

    An item larger than the capacity is cut into full pieces and a rest (``start`` is where a piece begins); no
    other item is cut. Containers never hold more than their capacity. Items with a null id or without a positive
    size and packs with a null name or no positive capacity give no rows; repeated items are packed as often as
    they come; of repeated pack names the smallest capacity counts. The result is the same in every run.

    ``packs`` is a table of settings (a few rows). What the driver sees is the histogram of lengths, bounded by
    the capacities whatever the number of items.
    """
    spark = items.sparkSession
    settings = packs.where(F.col(pack_col).isNotNull() & (F.col(capacity_col) > 0)).groupBy(F.col(pack_col).cast("string").alias("pack")).agg(F.min(F.col(capacity_col).cast("int")).alias("capacity"))
    sizes = items.where(F.col(id_col).isNotNull() & (F.col(size_col) > 0)).select(F.col(id_col).alias("id"), F.col(size_col).cast("int").alias("total"))
    sizes = sizes.withColumn("copy", F.monotonically_increasing_id())
    given = F.array(*[F.struct(F.lit(r["pack"]).alias("pack"), F.lit(r["capacity"]).alias("capacity")) for r in settings.orderBy("pack").collect()]).cast("array<struct<pack:string,capacity:int>>")
    every = sizes.select("*", F.explode(given).alias("given")).select("id", "total", "copy", "given.pack", "given.capacity")
    pieces = every.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / F.col("capacity")).cast("int") - 1)))
    pieces = pieces.select("pack", "capacity", "id", "copy", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.least("capacity", F.col("total") - F.col("piece") * F.col("capacity")).alias("size"))
    pieces = written(pieces)

    # the histogram: at most as many lengths as the capacities have tokens
    rows = pieces.groupBy("pack", "capacity", "size").agg(F.count("*").alias("n")).orderBy("pack", "size").collect()
    plans: dict[str, tuple] = {}
    for name in dict.fromkeys(r["pack"] for r in rows):
        own = [r for r in rows if r["pack"] == name]
        lengths, n = (np.array([r[c] for r in own], dtype=np.int64) for c in ("size", "n"))
        bounds = bucket_bounds(lengths, n, buckets)
        in_bucket = np.bincount(np.searchsorted(bounds, lengths), weights=n, minlength=len(bounds)).astype(np.int64)
        runs, total = container_plan(bounds, in_bucket, own[0]["capacity"])
        table = np.array(runs, dtype=np.int64)
        plans[name] = (bounds, table[np.lexsort((table[:, 1], table[:, 0]))])
    shipped = spark.sparkContext.broadcast(plans)

    # every length is split by its count, so that no part grows with the share that a length has of all items
    lengths = spark.createDataFrame(
        [(r["pack"], r["size"], int(np.searchsorted(plans[r["pack"]][0], r["size"])), -(-r["n"] // per_part)) for r in rows], "pack string, size int, bucket int, parts int"
    )
    split = pieces.join(F.broadcast(lengths), ["pack", "size"]).withColumn("part", F.pmod(F.xxhash64("id", "piece", "copy"), F.col("parts")).cast("int"))
    # where the items of a part begin in their bucket: one row per part
    cells = split.groupBy("pack", "bucket", "size", "part").agg(F.count("*").alias("n"))
    cells = cells.withColumn("base", F.sum("n").over(Window.partitionBy("pack", "bucket").orderBy("size", "part")) - F.col("n"))
    within = F.row_number().over(Window.partitionBy("pack", "size", "part").orderBy("id", "piece", "copy"))
    # (merged, not broadcast: both sides are already distributed by these columns)
    ranked = split.withColumn("within", within).join(cells.select("pack", "size", "part", "base").hint("merge"), ["pack", "size", "part"])
    ranked = ranked.select("pack", "id", "piece", "start", "size", "bucket", (F.col("base") + F.col("within") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            b, r = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            container = np.zeros(len(r), dtype=np.int64)
            for name in set(names):
                runs = shipped.value[name][1]
                at = names == name
                # runs are sorted by bucket and first rank: one number orders both
                width = int(runs[:, 1].max(initial=0)) + int(r[at].max(initial=0)) + 1
                run = runs[np.searchsorted(runs[:, 0] * width + runs[:, 1], b[at] * width + r[at], "right") - 1]
                container[at] = run[:, 3] + (r[at] - run[:, 1]) // run[:, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(container)], ["pack", "id", "piece", "start", "size", "container"])

    kind = items.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"pack string, id {kind}, piece int, start int, size int, container long")


def fill_report(packed: DataFrame, packs: DataFrame, *, pack_col: str, capacity_col: str) -> DataFrame:
    """``pack, capacity, n_pieces, n_containers, n_tokens, fill`` of each pack."""
    used = packed.groupBy("pack", "container").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    total = used.groupBy("pack").agg(F.sum("n").alias("n_pieces"), F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    sizes = packs.groupBy(F.col(pack_col).cast("string").alias("pack")).agg(F.min(F.col(capacity_col).cast("int")).alias("capacity"))
    return total.join(sizes, "pack").select("pack", "capacity", "n_pieces", "n_containers", "n_tokens", "fullest", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("fill"))
