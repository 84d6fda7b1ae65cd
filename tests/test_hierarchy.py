import random

import pytest
from pyspark.sql import functions as F

from graphweft.operators import hierarchy

LINKS = "hierarchy string, child string, parent string"


def expected(links):
    """Walk up from every node, in plain Python."""
    parent = {}
    for h, c, p in links:
        if c is not None and p is not None:
            parent[h, c] = min(p, parent.get((h, c), p))
    out = {}
    for h, c in parent:
        path, at = [], c
        while (h, at) in parent and at not in path:
            path.append(at)
            at = parent[h, at]
        out[h, c] = (min(path[path.index(at) :]), -1, None) if at in path else (at, len(path), [at, *path[:0:-1]])
    return out


def found(spark, links):
    rows = hierarchy.hierarchies(spark.createDataFrame(links, LINKS)).collect()
    return {(r.hierarchy, r.node_id): (r.root_id, r.depth, r.path) for r in rows}


def test_trees_chains_cycles(spark):
    rng = random.Random(4)
    links = [("a", f"c{i}", f"c{i + 1}") for i in range(70)]  # a long chain
    links += [("a", f"x{i}", "hub") for i in range(300)] + [("a", "hub", "c30")]  # a third of all rows at one parent
    links += [("b", "k3", "k1"), ("b", "k1", "k2"), ("b", "k2", "k3"), ("b", "under", "k2"), ("b", "leaf", "under")]
    links += [("b", "self", "self"), ("b", "p", "q"), ("b", "q", "p")]
    links += [("c", f"r{i}", f"r{rng.randrange(i)}") for i in range(1, 120)]
    links += links[:50] + [("a", None, "x"), ("a", "y", None)]
    rng.shuffle(links)
    got = found(spark, links)
    assert got == expected(links)
    assert got["b", "leaf"][:2] == ("k1", -1)
    below = {}
    for (h, _), (_, _, path) in got.items():
        for k, a in enumerate(path or []):
            n, height = below.get((h, a), (0, 0))
            below[h, a] = (n + 1, max(height, len(path) - k))
    sizes = hierarchy.subtree_sizes(hierarchy.hierarchies(spark.createDataFrame(links, LINKS)))
    assert {(r.hierarchy, r.node_id): (r.n_descendants, r.height) for r in sizes.collect()} == below


@pytest.mark.parametrize("seed", range(3))
def test_sizes_of_random_forests(spark, seed):
    rng = random.Random(seed)
    links = [("a", f"n{i}", f"n{rng.randrange(max(0, i - rng.choice([1, 1, 2, 9])), i)}") for i in range(1, 160) if i % 23]
    tree = hierarchy.hierarchies(spark.createDataFrame(links, LINKS))
    want = {}
    for r in tree.collect():
        for k, a in enumerate(r.path):
            n, height = want.get(a, (0, 0))
            want[a] = (n + 1, max(height, len(r.path) - k))
    assert {r.node_id: (r.n_descendants, r.height) for r in hierarchy.subtree_sizes(tree).collect()} == want


def test_sizes_of_nothing(spark):
    assert hierarchy.subtree_sizes(hierarchy.hierarchies(spark.createDataFrame([], LINKS))).collect() == []


def test_empty_and_several_parents(spark):
    assert found(spark, []) == {}
    assert found(spark, [("a", "n", "p2"), ("a", "n", "p1")]) == {("a", "n"): ("p1", 1, ["p1"])}


def test_graph_links_and_descendants(spark):
    edges = spark.createDataFrame(
        [("m", "c", " contains "), ("m", "c", "CONTAINS"), ("sub", "base", "Inherits"), ("m", "", "CONTAINS"), (None, "c", "DECLARES"), ("c", "f", "has_method"), ("c", "z", "CALLS"), ("c", "z", None)],
        "source_node_id string, target_node_id string, type string",
    ).withColumn("parent", F.lit("clash"))
    links = hierarchy.graph_links(edges)
    assert {tuple(r) for r in links.collect()} == {("ownership", "c", "m"), ("ownership", "f", "c"), ("inheritance", "sub", "base")}
    tree = hierarchy.hierarchies(links)
    assert {tuple(r) for r in hierarchy.descendants(tree).collect()} == {("ownership", "m", "c", 1), ("ownership", "m", "f", 2), ("ownership", "c", "f", 1), ("inheritance", "base", "sub", 1)}
    assert {(r.node_id, r.n_descendants, r.height) for r in hierarchy.subtree_sizes(tree).collect()} == {("m", 2, 2), ("c", 1, 1), ("base", 1, 1)}


if __name__ == "__main__":
    pytest.main([__file__])
