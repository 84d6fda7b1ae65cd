"""Most similar vectors for every vector: block matrix join with int8 tiles and error bounds.

The distinct vectors are hashed into blocks, and every pair of blocks is one task's work. A block is quantised to
int8 with one scale; the product of two int8 tiles approximates all cosines of the tile, and the quantisation
residuals bound the error. Only pairs whose upper bound reaches the threshold (the row's k-th best so far, or
the wanted least similarity) are computed again in double precision. The tasks' lists are merged by heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import parallelism, written

#: Rows and numbers of a block at most (about): two blocks in double precision take 128 MB, whatever the dimensions.
BLOCK_ROWS, BLOCK_NUMBERS = 262_144, 1 << 23
#: Copies of one vector (about) that are given their list in one part.
PER_PART = 100_000
#: Rows of a tile: its int8 product takes 4 MB.
TILE = 1024
#: float32 error of a product of int8 numbers after scaling, and of the double precision results' rounding.
EPS = 1e-6
DIGITS = 9


def usable(vector: Column) -> Column:
    """Not null, not empty, every element a finite number, not all zero."""
    return vector.isNotNull() & F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    m = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # no overflow in the squares
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _quantised(m: np.ndarray) -> tuple[np.ndarray, float, float]:
    """int8 codes, their scale and the largest norm of a row's residual."""
    scale = float(np.abs(m).max()) / 127
    q = np.rint(m / scale).astype(np.int8)
    return q, scale, float(np.linalg.norm(m - q * scale, axis=1).max())


class _Best:
    """The k best partners of each row so far; larger similarity first, then the smaller number."""

    def __init__(self, n: int, k: int, least: float):
        self.k, self.least = k, least
        self.row, self.other, self.sim = (np.empty(0, t) for t in (np.int64, np.int64, np.float64))
        self.limit = np.full(n, least)

    def add(self, row: np.ndarray, other: np.ndarray, sim: np.ndarray, order: np.ndarray) -> None:
        fit = sim >= self.limit[row]
        if not fit.any():
            return
        row, other, sim = (np.concatenate(x) for x in ((self.row, row[fit]), (self.other, other[fit]), (self.sim, sim[fit])))
        at = np.lexsort((order[other], -sim, row))
        row, other, sim = row[at], other[at], sim[at]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        kept = place < self.k
        self.row, self.other, self.sim = row[kept], other[kept], sim[kept]
        full = place == self.k - 1
        self.limit[row[full]] = np.maximum(self.limit[row[full]], sim[full])


def _block_pair(k: int, least: float | None):
    def run(table: pa.Table) -> pa.Table:
        order = table["no"].to_numpy()
        m, wanted, block = _unit(table["vec"]), table["wanted"].to_numpy(), table["block"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        best = _Best(len(order), k, -2.0 if least is None else least)
        if not len(left) or not len(right):
            left = right = np.empty(0, dtype=np.int64)
        else:
            (ql, sl, el), (qr, sr, er) = _quantised(m[left]), _quantised(m[right])
            bound = el + er + el * er + EPS
            if m.shape[1] * 127 * 127 >= 1 << 24:  # sums of that many products round in float32
                bound += m.shape[1] * 2.0**-24 * (1 + el) * (1 + er)
        for i in range(0, len(left), TILE):
            a, fa = left[i : i + TILE], ql[i : i + TILE].astype(np.float32)
            for j in range(i if low == high else 0, len(right), TILE):
                b = right[j : j + TILE]
                if not (wanted[a].any() or wanted[b].any()):
                    continue
                # products of int8 numbers, added up exactly: they stay below 2**24 for up to 1,000 dimensions (the bound covers more)
                tile = fa @ qr[j : j + TILE].astype(np.float32).T
                for rows, t in ((a, tile), (b, tile.T)):
                    open_ = wanted[rows] & (best.limit[rows] == best.least)
                    if least is None and open_.any() and t.shape[1] > k:
                        # the k-th best lower bound of the tile already excludes most pairs of rows without a full list
                        kth = np.partition(t[open_], t.shape[1] - k - 1, axis=1)[:, t.shape[1] - k - 1]
                        best.limit[rows[open_]] = kth.astype(np.float64) * sl * sr - bound
                la, lb = (np.where(wanted[x], best.limit[x], 9.0) for x in (a, b))
                if least is not None:
                    hit = tile >= np.float32((min(la.min(), lb.min()) - bound) / (sl * sr))
                else:
                    hit = (tile >= ((la - bound) / (sl * sr)).astype(np.float32)[:, None]) | (tile >= ((lb - bound) / (sl * sr)).astype(np.float32)[None, :])
                x, y = np.divmod(np.flatnonzero(hit.ravel()), len(b))
                if low == high and i == j:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    p, q = a[x], b[y]
                    sim = np.round(np.einsum("ij,ij->i", m[p], m[q]), DIGITS)
                    best.add(p[wanted[p]], q[wanted[p]], sim[wanted[p]], order)
                    best.add(q[wanted[q]], p[wanted[q]], sim[wanted[q]], order)
        return pa.table({"no": order[best.row], "other": order[best.other], "sim": best.sim})

    return run


def _merge(k: int):
    """Rows sorted by number: the k best of each run, by a heap that holds k of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True))
        out: list[tuple] = []
        for _, run_ in groupby(rows, key=lambda r: r[0]):
            out += heapq.nsmallest(k, run_, key=lambda r: (-r[2], r[1]))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["no", "other", "sim"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["no", "other", "sim"])

    return run


def most_similar(vectors: DataFrame, *, id_col: str, vector_col: str, space_cols: list[str] | None = None, k: int = 10, min_similarity: float | None = None, queries: Column | None = None) -> DataFrame:
    """The ``k`` most similar other vectors of every vector: ``id, neighbour, similarity, rank``.

    Vectors are compared by cosine with those of the same ``space_cols`` (nulls equal each other) and the same
    length. Null, empty and zero vectors and those with a null, NaN or infinite element take no part; nor do rows
    with a null id. A vector's exact copies come first, by id, then the others by similarity (rounded to 9
    digits) and id. ``min_similarity`` leaves out pairs below it and so lets most tiles end after the int8
    product. ``queries`` marks the rows that get a list; all are compared with all rows all the same.
    Ids should be unique: of repeated ids the first by vector stays. No rows give no rows.

    Exact copies are compared once: each distinct vector is kept with its ``k + 1`` smallest ids, which is all
    that any list can show of them. The result is exact; work grows with the square of the distinct vectors. With b
    blocks each of n distinct vectors of d numbers is shipped to b tasks, n * b * (8 d + 24) bytes in all; b is
    n / BLOCK_ROWS or n * d / BLOCK_NUMBERS, and at least what keeps all cores busy.
    """
    spark = vectors.sparkSession
    spaces = [F.col(c).cast("string") for c in space_cols or []]
    space = F.to_json(F.array(F.size(vector_col).cast("string"), *spaces), {"ignoreNullFields": "false"})
    want = queries if queries is not None else F.lit(True)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), space.alias("space"), F.coalesce(want, F.lit(False)).alias("wanted"))
    rows = written(rows)
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("space", "vec").orderBy("id"))).where(F.col("rn") <= k + 1)
    members = first.groupBy("space", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    hot = rows.groupBy("space", "vec").agg(F.max("wanted").alias("wanted"), F.count("*").alias("copies"))
    # numbered in the order of the ids, so that numbers stand for ids in the tasks, ties included
    reps = members.join(hot, ["space", "vec"]).withColumn("id", F.col("ids")[0]).orderBy("id").withColumn("no", F.monotonically_increasing_id())
    reps = written(reps)

    # blocks: as many as keep a block small, and enough pairs of them to fill the cluster
    least_blocks = int(np.ceil(np.sqrt(4 * parallelism(spark))))
    sizes = reps.groupBy("space").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims"))
    counts = written(sizes.select("space", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("n") * F.col("dims") / BLOCK_NUMBERS), F.least(F.lit(least_blocks), F.ceil(F.col("n") / TILE))).cast("int").alias("blocks")))
    n_pairs = counts.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    placed = reps.join(counts, "space").select("space", "no", "vec", "wanted", "blocks", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int").alias("block"))
    pairs = placed.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("space", F.least("block", "b").alias("low"), F.greatest("block", "b").alias("high"), "block", "no", "vec", "wanted")
    # a given number of partitions is not made smaller: pairs of blocks are much work for few bytes
    pairs = pairs.repartition(max(int(n_pairs), parallelism(spark)), "space", "low", "high")
    near = pairs.groupBy("space", "low", "high").applyInArrow(_block_pair(k, min_similarity), "no long, other long, sim double")
    near = near.repartition("no").sortWithinPartitions("no").mapInArrow(_merge(k), "no long, other long, sim double")

    # back to all rows: copies first, then the members of the neighbours
    ids = reps.select(F.col("no").alias("other"), F.col("ids").alias("other_ids"))
    lists = near.join(ids, "other").groupBy("no").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), F.col("other_ids").alias("ids")))).alias("near"))
    known = reps.join(lists, "no", "left").select("space", "vec", "ids", "near", F.ceil(F.col("copies") / PER_PART).cast("int").alias("parts"))
    # a vector that very many rows have is met in as many parts as that takes; there are few such vectors
    many = reps.where(F.col("copies") > PER_PART).select("space", "vec", F.ceil(F.col("copies") / PER_PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    asked = rows.where("wanted").join(F.broadcast(many), ["space", "vec"], "left").select("id", "space", "vec", part)
    known = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = asked.join(known, ["space", "vec", "part"]).select("id", "ids", "near")
    own = F.transform(F.array_except("ids", F.array("id")), lambda i: F.struct(F.lit(-2.0).alias("d"), i.alias("i")))
    others = F.flatten(F.transform(F.coalesce("near", F.array().cast("array<struct<d:double,ids:array<string>>>")), lambda x: F.transform(x["ids"], lambda i: F.struct(x["d"].alias("d"), i.alias("i")))))
    best = F.slice(F.array_sort(F.concat(own, others)), 1, k)
    return every.select("id", F.posexplode(best).alias("pos", "x")).select("id", F.col("x.i").alias("neighbour"), F.when(F.col("x.d") == -2.0, 1.0).otherwise(-F.col("x.d")).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def similar_pairs(lists: DataFrame, least: float) -> DataFrame:
    """Pairs of which one is in the other's list with at least that similarity, smaller id first: ``id_a, id_b``."""
    return lists.where(F.col("similarity") >= least).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
