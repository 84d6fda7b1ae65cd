from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

from graphweft.operators import orphans

T = datetime(2024, 1, 10)


def day(n):
    return T + timedelta(days=n)


def run(spark, edges, nodes, gone):
    e = spark.createDataFrame(edges, "edge_id long, source_node_id string, target_node_id string, loaded_at timestamp").withColumn("k", F.lit("clash")).withColumn("period", F.lit(1))
    n = spark.createDataFrame(nodes, "node_id string, created_at timestamp")
    g = spark.createDataFrame(gone, "node_id string, deleted_at timestamp")
    return {(r.edge_id, r.endpoint, r.reason) for r in orphans.orphan_references(e, n, g).collect()}


def test_reasons(spark):
    nodes = [("a", day(0)), ("a", day(5)), ("b", day(0)), ("late", day(3)), ("back", day(0)), ("back", day(4)), (None, day(0)), ("undated", None)]
    gone = [("b", day(2)), ("back", day(2)), ("ghost", day(1))]
    edges = [
        (1, "a", "b", day(1)), (2, "a", "b", day(2)), (3, "late", "a", day(2)), (4, "late", "a", day(3)), (5, "nope", "a", day(9)), (5, "nope", "a", day(9)),
        (6, "back", "", day(3)), (7, "back", None, day(4)), (8, "ghost", "a", day(5)), (9, "a", "undated", day(9)), (10, "nope", "a", None), (None, "a", "b", day(40)),
    ]
    assert run(spark, edges, nodes, gone) == {(2, "target", "deleted"), (3, "source", "late"), (5, "source", "missing"), (6, "source", "deleted"), (8, "source", "missing"), (9, "target", "late"), (None, "target", "deleted")}


def test_empty_tables(spark):
    assert run(spark, [], [("a", day(0))], []) == set()
    assert run(spark, [(1, "a", "b", day(0))], [], []) == {(1, "source", "missing"), (1, "target", "missing")}


def test_hot_key_in_many_periods(spark):
    edges = [(i, "hot", f"n{i % 7}", day(i % 400)) for i in range(900)]
    nodes = [("hot", day(200))] + [(f"n{i}", day(0)) for i in range(7)]
    got = run(spark, edges, nodes, [])
    assert got == {(i, "source", "late") for i in range(900) if i % 400 < 200}


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(orphans, "KEYS_PER_RANGE", 8)
    edges = [(i, f"s{i}", f"t{i}", day(1)) for i in range(100)]
    nodes = [(f"s{i}", day(0)) for i in range(100)] + [(f"t{i}", day(0)) for i in range(0, 100, 3)]
    assert run(spark, edges, nodes, []) == {(i, "target", "missing") for i in range(100) if i % 3}


def test_hot_key_in_parts(spark, monkeypatch):
    monkeypatch.setattr(orphans, "PER_PART", 10)
    edges = [(i, "nope", "there", day(1)) for i in range(200)]
    assert run(spark, edges, [("there", day(0))], []) == {(i, "source", "missing") for i in range(200)}


def test_compressed_bitmaps():
    rng = np.random.default_rng(4)
    sets = [np.arange(0), np.arange(70_000), np.array([0, 7, 65_535, (3 << 16) + 5, (43_199 << 16) + 65_535]), np.flatnonzero(rng.random(200_000) < 0.5), np.r_[1:9000, (2 << 16) : (2 << 16) + 9, (5 << 16) : (6 << 16)]]
    for x in sets:
        x = x.astype(np.int64)
        packed = orphans.compressed(x)
        assert list(orphans.decoded(packed)) == list(x) and len(packed) <= 4 + 8 * len(x)
        bits = orphans.Bits()
        bits.set(x & 0xFFFF)
        assert not len(orphans.and_not(x, bits.words))
        for y in sets:
            assert list(orphans.and_not(y.astype(np.int64), bits.words)) == list(y[~np.isin(y & 0xFFFF, x & 0xFFFF)])


def test_bitmaps_decide_what_meets_its_rows_again(spark):
    """Living keys are sieved out by the bitmaps; of 300 references only those that may be orphans are left."""
    nodes = [(f"n{i}", day(0)) for i in range(100)] + [("late", day(9)), ("back", day(0)), ("back", day(6))]
    gone = [("n3", day(4)), ("back", day(2))]
    edges = [(i, f"n{i % 100}", "nope" if i % 50 == 0 else f"n{(i + 1) % 100}", day(1 + i % 8)) for i in range(300)] + [(900, "late", "back", day(3)), (901, "late", "back", day(7)), (902, "late", "back", day(70))]
    e = spark.createDataFrame(edges, "edge_id long, source_node_id string, target_node_id string, loaded_at timestamp")
    refs = orphans.reference_ends(e, "edge_id", {"source": "source_node_id", "target": "target_node_id"}, "loaded_at").withColumn("slot", F.floor(F.col("loaded") / orphans.SLOT).cast("long"))
    facts = orphans.key_facts(spark.createDataFrame(nodes, "node_id string, created_at timestamp"), spark.createDataFrame(gone, "node_id string, deleted_at timestamp"), "node_id", "created_at", "deleted_at")
    found = {(r.k, r.slot * orphans.SLOT) for r in orphans.orphan_slots(orphans.dictionary(facts, refs), refs).collect()}
    at = lambda n: int(day(n).replace(tzinfo=timezone.utc).timestamp() * 1e6) // orphans.SLOT * orphans.SLOT
    assert found == {("nope", at(1 + i % 8)) for i in range(0, 300, 50)} | {("n3", at(d)) for i, d in ((i, 1 + i % 8) for i in range(300)) if d >= 4 and (i % 100 == 3 or (i + 1) % 100 == 3 and i % 50)} | {("late", at(3)), ("late", at(7)), ("back", at(3))}


def test_surviving_bits():
    bit = lambda *x: np.array(sorted((s << 16) | c for s, c in x), dtype=np.int64)
    periods = {
        0: {orphans.CREATED: bit((5, 1), (9, 2), (5, 4)), orphans.REFERENCED: bit((5, 1), (6, 1), (8, 2), (9, 2), (10, 2), (7, 3)), orphans.DELETED: bit((20, 4))},
        1: {orphans.REFERENCED: bit((0, 1), (3, 2), (0, 3), (2, 4), (8, 4), (3, 5)), orphans.DELETED: bit((3, 2)), orphans.RECREATED: bit((7, 4))},
        2: {orphans.REFERENCED: bit((0, 2), (0, 4), (0, 1))},
    }
    left = {p: {(int(b >> 16), int(b & 0xFFFF)) for b in bits} for p, bits in orphans.surviving(periods)}
    assert left == {0: {(5, 1), (8, 2), (9, 2), (7, 3)}, 1: {(3, 2), (0, 3), (2, 4), (3, 5)}, 2: {(0, 2)}}
