import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweft.llm import similar, top_n


def best(rows, n):
    """Brute force over (group, item, score)."""
    top = {}
    for g, i, s in rows:
        if i is not None and s is not None and s == s:
            top[g, i] = max(s, top.get((g, i), s))
    out = set()
    for group in {g for g, _ in top}:
        order = sorted(((s, i) for (g, i), s in top.items() if g == group), reverse=True)[:n]
        out |= {(group, i, s, r) for r, (s, i) in enumerate(order, 1)}
    return out


def test_top_n(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", f"g{k % 40}", None]), rng.choice(["é", "Z", "a", None]) and f"i{rng.randrange(90)}", rng.choice([1.0, 2.0, rng.random(), None, float("nan"), float("inf")])) for k in range(4000)]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "g string, item string, s double").withColumns({"rank": F.lit(1), "score": F.lit("clash")})
    got = {tuple(r) for r in top_n.top_n_per_group(df, ["g"], "s", "item", 7).collect()}
    assert got == best(rows, 7)
    assert top_n.top_n_per_group(df.limit(0), ["g"], "s", "item").collect() == []
    two = top_n.top_n_per_group(df.withColumn("h", F.lit(3)), ["g", "h"], "s", "item", 2)
    assert two.columns == ["g", "h", "item", "s", "rank"] and two.count() == len(best(rows, 2))


def brute(vectors, k):
    out = {}
    for i, v in vectors:
        near = []
        for j, w in vectors:
            if i != j and len(v) == len(w):
                same = v == w
                near.append((-2.0 if same else -round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), j))
        out[i] = sorted(near)[:k]
    return out


@pytest.mark.parametrize("least", [None, 0.9])
def test_similar(spark, monkeypatch, least):
    monkeypatch.setattr(similar, "TILE", 16)
    monkeypatch.setattr(similar, "BLOCK_ROWS", 40)
    monkeypatch.setattr(similar, "PER_PART", 20)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 8))
    vecs = [(f"v{i:03}", [float(x) for x in v]) for i, v in enumerate(base)]
    vecs += [(f"w{i:03}", [float(x) for x in base[i] + rng.normal(scale=0.05, size=8)]) for i in range(60)]
    vecs += [(f"copy{i:03}", vecs[0][1]) for i in range(90)]  # a third of all rows are one vector
    vecs += [("long", [1.0] * 9), ("long2", [2.0] * 9)]
    bad = [("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("none", None), ("hole", [1.0, None]), ("inf", [float("inf")] * 8), (None, [1.0] * 8), ("empty", [])]
    df = spark.createDataFrame(vecs + bad + vecs[:3], "id string, vec array<double>").withColumns({"space": F.lit(1), "block": F.lit(2)}).dropDuplicates(["id"])
    lists = similar.most_similar(df, id_col="id", vector_col="vec", k=5, min_similarity=least).collect()
    got = {}
    for r in lists:
        got.setdefault(r.id, []).append((r.rank, r.neighbour, r.similarity))
    want = brute(vecs, 5)
    for i, near in want.items():
        near = [(d, j) for d, j in near if least is None or d == -2.0 or -d >= least]
        assert [(j, 1.0 if d == -2.0 else pytest.approx(-d, abs=1e-8)) for d, j in near] == [(j, s) for _, j, s in sorted(got.get(i, []))], i
    assert set(got) <= {i for i, _ in vecs}


def test_similar_of_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_NUMBERS", 30_000)  # 19 rows a block
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 1536))
    vecs = [(f"v{i:02}", [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base + rng.normal(scale=0.2, size=base.shape)]))]
    lists = similar.most_similar(spark.createDataFrame(vecs, "id string, vec array<double>"), id_col="id", vector_col="vec", k=3).collect()
    got = {}
    for r in sorted(lists, key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == {i: [j for _, j in near] for i, near in brute(vecs, 3).items()}


def test_similar_query_rows_and_spaces(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "m"), ("b", [1.0, 0.1], "m"), ("c", [1.0, 0.0], "n"), ("d", [1.0, 0.2], None), ("e", [1.0, 0.3], None)], "id string, v array<double>, model string")
    lists = similar.most_similar(df, id_col="id", vector_col="v", space_cols=["model"], k=3)
    assert {(r.id, r.neighbour) for r in lists.collect()} == {("a", "b"), ("b", "a"), ("d", "e"), ("e", "d")}
    some = similar.most_similar(df, id_col="id", vector_col="v", k=2, queries=F.col("id") == "a")
    assert [(r.id, r.neighbour) for r in some.orderBy("rank").collect()] == [("a", "c"), ("a", "b")]
    assert similar.similar_pairs(lists, 0.99).count() == 2
    assert similar.most_similar(df.limit(0), id_col="id", vector_col="v").collect() == []
