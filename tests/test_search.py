import math
import random
import re

import pytest
from pyspark.sql import functions as F

from graphweft.functions import text, vector
from graphweft.operators import search
from graphweft.params import Details, InvalidInput, Search
from graphweft.plans import graph_queries
from graphweft.sources import embedding

COLUMNS = "node_id string, graph_id string, kind string, name string, qualified_name string, source_path string, summary string, docstring string, signature string, is_public boolean, embedding_text string"


def scores(nodes, query, vec=None):
    """An independent scorer in plain Python."""
    terms = re.findall(r"[a-z0-9_]+", query.lower())
    rows = [n for n in nodes if n["kind"] != "Library"]
    hay = [" ".join(n[c] or "" for c in ("name", "qualified_name", "summary", "docstring", "signature", "embedding_text")).lower() for n in rows]
    tokens = [re.findall(r"[a-z0-9_]+", h) for h in hay]
    average = sum(map(len, tokens)) / max(len(rows), 1)
    df = {t: terms.count(t) * sum(t in x for x in tokens) for t in terms}
    out = {}
    for n, h, x in zip(rows, hay, tokens, strict=True):
        raw = 0.0
        for t in terms:
            if tf := x.count(t):
                raw += math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(len(x), 1) / average))
        bm = round(raw, 6) if raw > 0 else 0.0
        hits = sum(t in h for t in terms)
        exact = query.lower() in ((n["name"] or "").lower(), (n["qualified_name"] or "").lower())
        if hits or bm or exact:
            kw = bm if bm > 0 else hits / max(len(terms), 1)
            out[n["node_id"]] = (kw, 0.65 * kw + 0.2 * exact + 0.05 * bool(n["is_public"]) + 0.03 * (n["kind"] in ("Function", "Class")))
    return out


def frame(spark, nodes):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(n[c] for c in names) for n in nodes], COLUMNS)


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["cache", "cached", "Flag", "the", "engine_x", "load"]
    say = lambda k: " ".join(rng.choices(words, k=k)) if rng.random() > 0.15 else None
    kinds = ["Function", "Class", "Module", "Library", "Parameter"]
    return [
        {"node_id": f"n{i}", "graph_id": f"g{i % 3}", "kind": rng.choice(kinds), "name": rng.choice(words), "qualified_name": f"{rng.choice(words)}.q{i}", "source_path": None, "summary": say(3), "docstring": say(9), "signature": say(2), "is_public": rng.choice([True, False, None]), "embedding_text": say(2)}
        for i in range(n)
    ]


@pytest.mark.parametrize(("seed", "query"), [(1, "the cache"), (2, "the cache of the cache the"), (3, "Flag"), (4, "nothing here"), (5, "!?")])
def test_scores_equal_the_plain_scorer(spark, seed, query):
    nodes = made(seed)
    got = {r.node_id: r for r in search.scored(search.features(search.in_scope(frame(spark, nodes)), Search(query)), Search(query)).collect()}
    want = scores(nodes, query)
    assert set(got) == set(want)
    for k, (kw, total) in want.items():
        assert got[k].keyword_score == pytest.approx(kw, abs=2e-6) and got[k].score == pytest.approx(total, abs=3e-6)


def test_scope_order_and_derived_tables(spark):
    nodes = made(7, 90)
    df = frame(spark, nodes)
    s = Search("the cache", graph_ids=("g1",), kinds=("Function", "Class"), top_k=5)
    states = df.withColumns({"metadata": F.struct("embedding_text", F.lit(None).cast("array<double>").alias("embedding")), "updated_at": F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00"))}).drop("embedding_text")
    older = states.withColumns({"updated_at": F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")), "summary": F.lit("the cache the cache")})
    states = states.union(older)
    top = search.search_candidates(states, s).collect()
    want = scores([n for n in nodes if n["graph_id"] == "g1" and n["kind"] in s.kinds], s.query)
    order = sorted(want, key=lambda k: (round(want[k][1], 5), round(want[k][0], 5)), reverse=True)[:5]
    assert {r.node_id for r in top} == set(order) and [r.score for r in top] == sorted((r.score for r in top), reverse=True)
    post = search.postings(df)
    a = {tuple(r) for r in search.bm25_indexed(post, search.term_stats(post), search.scope_stats(df), s).collect()}
    assert a == {tuple(r) for r in search.bm25_scores(search.current_features(states, s), s).collect()}
    assert a == {tuple(r) for r in search.bm25_indexed(post, search.term_stats(post), search.scope_stats(df), Search(s.query, graph_id="g1", kinds=s.kinds)).collect()}
    routes = [tuple(r) for r in search.route_graphs(search.search_candidates(states, s)).collect()]
    assert routes == [("g1", top[0].score, 1)]
    got = search.answer(search.search_candidates(states, s), s, with_vectors=False).first()
    assert got.candidate_count == 5 and [m.node_id for m in got.top_matches] == [r.node_id for r in top] and got.resolved_graph_ids == ["g1"] and len(got.warnings) == 1
    assert got.context_preview.count(" | ") == 2 and [r.graph_id for r in got.routed_graphs] == ["g1"]
    plan = search.current_features(states, s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") > plan.index("Aggregate")  # the scope lies below the merge


def test_index_is_stored_by_term(spark, tmp_path):
    df = frame(spark, made(7, 90))
    search.write_index(df, str(tmp_path / "i"))
    s = Search("the cache")
    stored = search.bm25_indexed(*search.read_index(spark, str(tmp_path / "i")), s)
    assert {tuple(r) for r in stored.collect()} == {tuple(r) for r in search.bm25_scores(search.features(search.in_scope(df), s), s).collect()}


def test_batch_search_splits_hot_terms(spark, monkeypatch):
    df = frame(spark, made(3, 90))
    asked = spark.createDataFrame([(1, "the cache"), (2, "Flag"), (3, None), (None, "the"), (4, "")], "query_id long, query string")
    whole = {tuple(r) for r in search.batch_bm25(df, asked, 4).collect()}
    monkeypatch.setattr(search, "PER_PART", 7)
    assert whole == {tuple(r) for r in search.batch_bm25(df, asked, 4).collect()} and {r[0] for r in whole} == {1, 2}
    assert search.batch_bm25(df.limit(0), asked, 4).count() == 0 and search.batch_bm25(df, asked.limit(0), 4).count() == 0


def _shuffled(spark, since=-1):
    """The last stage so far, and the rows that the stages after ``since`` shuffled."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    none = lambda: jvm.java.util.ArrayList()
    listed = sc.statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none())
    stages = [s for s in map(listed.apply, range(listed.size())) if s.stageId() > since]
    return max([since, *(s.stageId() for s in stages)]), sum(s.shuffleWriteRecords() for s in stages)


def test_batch_search_shuffles_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    # every text has the hot term, some are alike (equal scores go by node), and its repeats in a query weigh less than nothing
    nodes = [(f"n{rng.random()}", " ".join(["and"] * rng.choice([1, 1, 3]) + rng.choices(words, k=rng.choice([2, 2, 9])))) for _ in range(1500)]
    queries = [(i, " ".join([*["and"] * rng.choice([1, 2]), *rng.choices(words, k=rng.choice([0, 1, 3]))])) for i in range(300)]
    df = spark.createDataFrame(nodes, "node_id string, summary string")
    df = df.select("node_id", F.lit("g").alias("graph_id"), F.lit("Function").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("name", "qualified_name", "docstring", "signature", "embedding_text")], "summary")
    tokens = {n: t.split() for n, t in nodes}
    average = sum(map(len, tokens.values())) / len(tokens)
    count = {w: sum(w in t for t in tokens.values()) for w in ["and", *words]}
    want = set()
    for q, asked in queries:
        scores = {}
        for n, t in tokens.items():
            s = 0.0
            for w in set(asked.split()):
                m, tf = asked.split().count(w), t.count(w)
                d = m * count[w]
                s += m * math.log(1 + (len(tokens) - d + 0.5) / (d + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / average))
            if round(s, 6) > 0:
                scores[n] = round(s, 6)
        want |= {(q, n, r) for r, n in enumerate(sorted(scores, key=lambda n: (-scores[n], n))[:5], 1)}
    assert len({q for q, _, _ in want}) < len(queries)  # some only ask what weighs less than nothing
    asked = spark.createDataFrame(queries, "query_id long, query string")
    for first, chunk, block in [(8_192, 131_072, 262_144), (20, 50, 200)]:
        monkeypatch.setattr(search, "FIRST", first, raising=False)
        monkeypatch.setattr(search, "CHUNK", chunk, raising=False)
        monkeypatch.setattr(search, "BLOCK", block, raising=False)
        since, _ = _shuffled(spark)
        got = {(r.query_id, r.node_id, r["rank"]) for r in search.batch_bm25(df, asked, 5).collect()}
        assert got == want
        assert _shuffled(spark, since)[1] < 0.2 * len(nodes) * len(queries)


def test_batch_search_rounds_as_sql(spark, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    scores = [12.83725, 0.00005, 1.00005, 7.123449, 2.0]
    made = spark.createDataFrame([(i, 1, f"n{i}", x) for i, x in enumerate(scores)], "query_id long, rank int, node_id string, bm25 double")
    monkeypatch.setattr(graph_queries.search, "batch_bm25", lambda *_: made)
    monkeypatch.setattr(graph_queries, "table", lambda *_: spark.createDataFrame([], "doc_id long, title string"))
    monkeypatch.setattr(graph_queries, "_current", lambda *_: None)
    got = [r.bm25 for r in graph_queries.batch_search(spark, "").orderBy("query_id").collect()]
    assert got == [duckdb.execute("select round(?::double, 4)", [x]).fetchone()[0] for x in scores]


def test_nearest_of_each(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in search.nearest_of_each(df, df.where("id % 10 = 0 or id = 99"), id_col="id", vector_col="v", k=4, block=2).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    dot = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)), 6)
    assert got == {i: [j for _, j in sorted((-dot(v, w), j) for j, w in rows if w)[:4]] for i, v in rows if v and i % 10 == 0}


def test_empty_scope_and_plan(spark):
    df = frame(spark, made(1))
    found = lambda s: search.best(search.scored(search.features(search.in_scope(df, s.scope), s), s), 8)
    assert found(Search("cache", graph_ids=("none",))).collect() == []
    plan = found(Search("cache"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_parameters():
    for bad in (lambda: Search(" "), lambda: Search("x", top_k=0), lambda: Search("x", top_k=51), lambda: Search("x", graph_id="a", graph_ids=("b",)), lambda: Details(()), lambda: Details(("a",) * 101)):
        with pytest.raises(InvalidInput):
            bad()


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0]), ([None], [1.0]), ([float("nan")], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(vector.similarity(F.col("a"), F.col("b"))).collect()] == [11.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    e = [r[0] for r in spark.createDataFrame([("a, b|a",), ("",)], "t string").select(embedding.hash_vector(F.col("t"))).collect()]
    assert sum(x * x for x in e[0]) == pytest.approx(1.0, abs=1e-5) and len(e[0]) == 32 and e[1] == [0.0] * 32


def test_text(spark):
    df = spark.createDataFrame([(" A b--C. ", "\t \n x \n y", "|a | b| ")], "s string, d string, e string")
    r = df.select(text.slug(F.col("s")), text.first_line(F.col("d"), F.lit("-")), text.slug(F.lit("??")), text.graph_id(F.lit("My Lib"), F.lit(" ")), text.compress(F.array(F.lit(" a "), F.lit(" "), F.lit("b"), F.lit("c")), 2)).first()
    assert tuple(r) == ("a-b-c", "x", "unknown", "my-lib:unknown", "a | b")
