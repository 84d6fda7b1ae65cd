"""References to records that do not exist: bitmaps of referenced keys AND-NOT bitmaps of living keys.

Keys are dictionary-encoded once as (range, code): the range is a hash of the key, the code its rank among the keys
of the range. Per range and period, compressed bitmaps over (slot of time, code) hold what is referenced, and what is
created, deleted and created anew. Tasks build them from the rows that they have, and nothing but the bitmaps is
shuffled. The living keys follow from the events of the periods before (packed bits, a code each) and, within a
period, from those of the slots before. What is left of *referenced AND NOT living* is decoded, and only those few
keys and slots meet their reference rows again for the exact reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import discard, written

#: Keys of one range: packed bits over it take at most 8 KB, whatever the number of all keys is.
KEYS_PER_RANGE = 65_536
#: Microseconds of a slot, and slots of a period of the bitmaps (30 days).
SLOT, SLOTS = 60_000_000, 43_200
#: References of one key and slot (about) that meet their key in one part.
PER_PART = 100_000
#: What a bitmap holds.
REFERENCED, CREATED, DELETED, RECREATED = range(4)


def key_facts(parents: DataFrame, tombstones: DataFrame, key: str, created: str, deleted: str) -> DataFrame:
    """One row per parent key: first creation, deletion, first creation after the deletion (microseconds)."""
    gone = tombstones.select(F.col(key).alias("k"), F.unix_micros(F.col(deleted).cast("timestamp")).alias("deleted")).where("k is not null").groupBy("k").agg(F.max("deleted").alias("deleted"))
    rows = parents.select(F.col(key).alias("k"), F.unix_micros(F.col(created).cast("timestamp")).alias("created")).where("k is not null and k <> ''")
    # creations are first reduced to one row per key and instant, so that resent rows do not reach the join
    rows = rows.groupBy("k", "created").agg(F.lit(1).alias("one")).join(gone, "k", "left")
    return rows.groupBy("k").agg(
        F.min("created").alias("first_created"),
        F.max("deleted").alias("deleted"),
        F.min(F.when(F.col("created") > F.col("deleted"), F.col("created"))).alias("recreated"),
    )


def reference_ends(links: DataFrame, link_id: str, ends: dict[str, str], loaded: str, period: str = "month") -> DataFrame:
    """One row per link and end with a usable key; ``ends`` maps the name of an end to its column."""
    pairs = F.array(*[F.struct(F.lit(name).alias("endpoint"), F.col(c).alias("k")) for name, c in ends.items()])
    return (
        links.select(F.col(link_id).alias("link"), F.col(loaded).cast("timestamp").alias("loaded_ts"), F.explode(pairs).alias("e"))
        .select("link", "e.endpoint", "e.k", F.unix_micros("loaded_ts").alias("loaded"), F.date_trunc(period, "loaded_ts").cast("date").alias("period"))
        .where("k is not null and k <> '' and loaded is not null")
    )


# ---------------------------------------------------------------- bitmaps

#: Codes of a container from which packed bits are smaller than a list of them.
PACKED = 4096


def compressed(bits: np.ndarray) -> bytes:
    """The bitmap of sorted distinct numbers ``slot << 16 | code``: a container for each slot that has any.

    A container lists its codes in two bytes each, or holds packed bits where it has PACKED codes and more.
    """
    slot, code = bits >> 16, bits & 0xFFFF
    slots, first, count = np.unique(slot, return_index=True, return_counts=True)
    packed = count >= PACKED
    out = [np.array([len(slots)], "<u4"), slots.astype("<u2"), count.astype("<u4"), code[~np.repeat(packed, count)].astype("<u2")]
    for k in np.flatnonzero(packed):
        flags = np.zeros(1 << 16, dtype=bool)
        flags[code[first[k] : first[k] + count[k]]] = True
        out.append(np.packbits(flags))
    return b"".join(x.tobytes() for x in out)


def decoded(bitmap: bytes) -> np.ndarray:
    """The sorted numbers of a bitmap."""
    n = int(np.frombuffer(bitmap, "<u4", 1)[0])
    slots = np.frombuffer(bitmap, "<u2", n, 4).astype(np.int64)
    count = np.frombuffer(bitmap, "<u4", n, 4 + 2 * n).astype(np.int64)
    packed = count >= PACKED
    listed = int(count[~packed].sum())
    out = np.repeat(slots << 16, count)
    kind, at = np.repeat(packed, count), 4 + 6 * n
    out[~kind] |= np.frombuffer(bitmap, "<u2", listed, at)
    if packed.any():
        words = np.frombuffer(bitmap, np.uint8, int(packed.sum()) << 13, at + 2 * listed).reshape(-1, 1 << 13)
        out[kind] |= np.concatenate([np.flatnonzero(np.unpackbits(w)) for w in words])
    return out


class Bits:
    """Packed bits over the codes of a range."""

    def __init__(self):
        self.words = np.zeros(1 << 13, dtype=np.uint8)

    def set(self, codes: np.ndarray) -> None:
        np.bitwise_or.at(self.words, codes >> 3, (128 >> (codes & 7)).astype(np.uint8))


def and_not(bits: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The numbers of ``bits`` whose codes ``other`` (packed bits) lacks."""
    code = bits & 0xFFFF
    return bits[(other[code >> 3] >> (7 - (code & 7))) & 1 == 0]


def _of_code(bits: np.ndarray) -> np.ndarray:
    """For each code of a range the slot that ``bits`` has it in, or more than any."""
    out = np.full(1 << 16, 1 << 20, dtype=np.int64)
    out[bits & 0xFFFF] = bits >> 16
    return out


def surviving(periods: dict[int, dict[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """Per period what is referenced AND NOT surely living; ``periods`` has the bitmaps of one range by period and kind.

    A key surely lives in a slot if it was created in an earlier one and not deleted up to the slot, or created
    anew in an earlier one.
    """
    none = np.empty(0, dtype=np.int64)
    created, deleted, again = Bits(), Bits(), Bits()
    for period in sorted(periods):
        kinds = periods[period]
        made, gone, anew = (kinds.get(k, none) for k in (CREATED, DELETED, RECREATED))
        before = [b.words.copy() for b in (created, again)]
        deleted.set(gone & 0xFFFF)
        # living through the whole period, by the events of the periods before it
        left = and_not(kinds.get(REFERENCED, none), (before[0] & ~deleted.words) | before[1])
        created.set(made & 0xFFFF)
        again.set(anew & 0xFFFF)
        if len(left):
            # within the period, by the events of the slots before; what happened in an earlier period is a bit
            slot, code = left >> 16, left & 0xFFFF
            bit = lambda words: (words[code >> 3] >> (7 - (code & 7))) & 1 == 1  # noqa: B023, E731
            there = bit(before[0]) | (_of_code(made)[code] < slot)
            ended = (bit(deleted.words) & (_of_code(gone)[code] == 1 << 20)) | (_of_code(gone)[code] <= slot)
            back = bit(before[1]) | (_of_code(anew)[code] < slot)
            yield period, left[~((there & ~ended) | back)]


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the rows ``r, code, kind, slot`` that a task has, in parts of some million rows."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal size
        r, code, kind, slot = np.concatenate(held, axis=1)
        held.clear()
        size = 0
        period, within = np.divmod(slot, SLOTS)
        order = np.lexsort((code, within, kind, period, r))
        r, period, kind, bits = r[order], period[order], kind[order], ((within << 16) | code)[order]
        cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (period[1:] != period[:-1]) | (kind[1:] != kind[:-1])])
        maps = [compressed(np.unique(x)) for x in np.split(bits, cut[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(r[cut]), pa.array(period[cut]), pa.array(kind[cut]), pa.array(maps, pa.binary())], ["r", "period", "kind", "bitmap"])

    for batch in batches:
        held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
        size += batch.num_rows
        if size > 4_000_000:
            yield from out()
    if size:
        yield from out()


def _range_orphans(table: pa.Table) -> pa.Table:
    """Of one key range: codes and slots that survive."""
    periods: dict[int, dict[int, list]] = {}
    for period, kind, bitmap in zip(*[table[c].to_pylist() for c in ("period", "kind", "bitmap")], strict=True):
        periods.setdefault(period, {}).setdefault(kind, []).append(decoded(bitmap))
    merged = {p: {k: np.unique(np.concatenate(x)) for k, x in kinds.items()} for p, kinds in periods.items()}
    found = [(p * SLOTS + (bits >> 16), bits & 0xFFFF) for p, bits in surviving(merged)]
    slot, code = (np.concatenate([np.empty(0, dtype=np.int64), *[x[k] for x in found]]) for k in (0, 1))
    return pa.table({"r": pa.array(np.full(len(slot), table["r"][0].as_py() if len(table) else 0)), "code": code, "slot": slot})


# ---------------------------------------------------------------- Spark


def dictionary(facts: DataFrame, refs: DataFrame) -> DataFrame:
    """``k, r, code`` and the facts of every key, of those that are only referred to as well (``known`` is null)."""
    every = facts.withColumn("known", F.lit(True)).unionByName(refs.select("k").distinct(), allowMissingColumns=True)
    keys = written(every.groupBy("k").agg(*[F.max(c).alias(c) for c in ("known", "first_created", "deleted", "recreated")]))
    ranges = max(1, -(-keys.count() // (KEYS_PER_RANGE // 2)))
    rows = keys.withColumn("r", F.pmod(F.xxhash64("k"), F.lit(ranges)))
    out = written(rows.withColumn("code", (F.row_number().over(Window.partitionBy("r").orderBy("k")) - 1).cast("long")))
    discard(keys)
    return out


def orphan_slots(keys: DataFrame, refs: DataFrame) -> DataFrame:
    """``k, slot, n`` with the facts of the key, for the keys and slots whose reference bits survive AND NOT.

    Those are all that have an orphan. ``n`` is the number of reference rows that will be met again.
    """
    # a key that all links refer to becomes one row per slot before anything else
    seen = refs.groupBy("k", "slot").agg(F.count("*").alias("n"))
    coded = written(seen.join(keys.select("k", "r", "code"), "k").select("r", "code", "slot", "n"))
    event = lambda c, kind: F.struct(F.lit(kind).cast("long").alias("kind"), F.floor(F.col(c) / SLOT).cast("long").alias("slot"))
    events = keys.select("r", "code", F.explode(F.array(event("first_created", CREATED), event("deleted", DELETED), event("recreated", RECREATED))).alias("e")).select("r", "code", "e.kind", "e.slot").where("slot is not null")
    rows = events.unionByName(coded.select("r", "code", F.lit(REFERENCED).cast("long").alias("kind"), "slot"))
    maps = rows.mapInArrow(_built, "r long, period long, kind long, bitmap binary")
    found = maps.groupBy("r").applyInArrow(_range_orphans, "r long, code long, slot long")
    out = written(found.join(coded, ["r", "code", "slot"]).join(keys, ["r", "code"]).drop("r", "code"))
    discard(coded)
    return out


def orphan_references(links: DataFrame, parents: DataFrame, tombstones: DataFrame, *, link_id: str = "edge_id", ends: dict[str, str] | None = None, loaded: str = "loaded_at", key: str = "node_id", created: str = "created_at", deleted: str = "deleted_at", period: str = "month") -> DataFrame:
    """References whose key is not alive when they are loaded: ``edge_id, endpoint, reason, period, key``.

    ``reason`` is ``missing`` (no parent row at all), ``late`` (first created after the load) or ``deleted``
    (deleted not after the load and not created anew in between). Rows sent twice count once. Null or empty
    keys are no references; links without a load time or id are left out; null creations never make a key
    alive; an empty links table gives an empty result, an empty parents table makes every reference missing.
    """
    ends = ends or {"source": "source_node_id", "target": "target_node_id"}
    refs = written(reference_ends(links, link_id, ends, loaded, period).withColumn("slot", F.floor(F.col("loaded") / SLOT).cast("long")))
    keys = dictionary(key_facts(parents, tombstones, key, created, deleted), refs)
    suspects = orphan_slots(keys, refs)
    discard(keys)
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("first_created").isNull() | (F.col("first_created") > F.col("loaded")), "late")
        .when((F.col("deleted") <= F.col("loaded")) & (F.col("recreated").isNull() | (F.col("recreated") > F.col("loaded"))), "deleted")
    )
    # a key and slot of very many rows are met in as many parts as that takes; so many rows have few such keys
    many = suspects.where(F.col("n") > PER_PART).select("k", "slot", F.ceil(F.col("n") / PER_PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("link", "endpoint"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    ends_of = refs.join(F.broadcast(many), ["k", "slot"], "left").select("link", "endpoint", "k", "slot", "loaded", "period", part)
    split = suspects.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PER_PART).cast("int") - 1)))
    near = ends_of.join(split, ["k", "slot", "part"])
    return near.select(F.col("link").alias(link_id), "endpoint", reason.alias("reason"), "period", F.col("k").alias("key")).where("reason is not null").distinct()


def orphan_report(orphans: DataFrame, refs: DataFrame, table_name: str) -> DataFrame:
    """Orphans per table, end, period and reason beside all references of that end and period."""
    all_refs = refs.select("link", "endpoint", "period").distinct().groupBy("endpoint", "period").agg(F.count("*").alias("n_references"))
    bad = orphans.groupBy("endpoint", "period", "reason").agg(F.count("*").alias("n_orphans"))
    return bad.join(all_refs, ["endpoint", "period"]).select(F.lit(table_name).alias("table_name"), "endpoint", F.date_format("period", "yyyy-MM-dd").alias("period"), "reason", "n_orphans", "n_references")
