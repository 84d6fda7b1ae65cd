"""Candidate search: scope, BM25, substring hits, vector similarity, hybrid score, top k.

The scope is filtered in the scan, before rows of a node are merged, as a node's id fixes its graph and kind. What a
query asks of a row (length, term frequencies, hits) is computed where the row is read, so that the merge shuffles a
few numbers instead of texts. One aggregate over the scope gives the statistics, one pass the scores; both stay in
generated JVM code. With the stored postings and statistics a query reads only its terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphweft.functions import scoring, text, vector
from graphweft.operators.merge import current_rows
from graphweft.params import Search
from graphweft.session import parallelism, written

#: Terms of the queries of a block (about), and nodes (about) that meet a block in one part.
BLOCK, PER_PART = 262_144, 1_000_000
#: Asked terms at most that are sent to all tasks (some 10 MB).
MOST_TERMS = 200_000
#: Nodes that a block scores at once: few at first, as their scores bound the work on all others; bytes of them at most (about).
FIRST, CHUNK, CHUNK_BYTES = 8_192, 131_072, 64 << 20
#: What a search reads of a node.
FIELDS = {c: c for c in ("graph_id", "kind", "name", "qualified_name", "source_path", "summary", "docstring", "signature", "is_public")}
META = {"embedding_text": "metadata.embedding_text", "embedding": "metadata.embedding"}


def searchable(nodes: DataFrame, *, vectors: bool = False) -> DataFrame:
    """The current rows of nodes with the columns that a search reads (embeddings only if asked for)."""
    meta = META if vectors else {"embedding_text": META["embedding_text"]}
    return current_rows(nodes, "node_id", "updated_at", FIELDS | meta)


def in_scope(nodes: DataFrame, graph_ids: tuple[str, ...] = (), kinds: tuple[str, ...] = ()) -> DataFrame:
    """Without Library nodes, in the given graphs and of the given kinds; filters that are not given are not built."""
    out = nodes.where(F.col("kind") != "Library")
    if graph_ids:
        out = out.where(F.col("graph_id").isin(*graph_ids))
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def _terms(search: Search) -> list[tuple[str, str, int]]:
    return [(f"t{i}", term, m) for i, (term, m) in enumerate(search.distinct_terms.items())]


def _frequency(term: str) -> Column:
    return F.size(F.filter("tokens", lambda x: x == term))


#: What a search shows of a node.
SHOWN = ("graph_id", "kind", "name", "qualified_name", "source_path", "is_public", "summary")


def features(rows: DataFrame, search: Search, query_vector: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """What a search needs of node rows, instead of their texts: length in tokens, the frequency of every query term
    (``t0``, ``t1``, ...), ``hits``, ``exact_match`` and ``vector_score`` beside the columns shown and ``keep``."""
    rows = rows.withColumn("haystack", text.haystack()).withColumn("tokens", text.words(F.col("haystack")))
    tf = [_frequency(term).alias(name) for name, term, _ in _terms(search)]
    sim = vector.similarity(query_vector, F.col("embedding")) if query_vector is not None else F.lit(0.0)
    return rows.select("node_id", *SHOWN, *keep, F.size("tokens").alias("length"), *tf, hits(search).alias("hits"), exact(search).alias("exact_match"), sim.alias("vector_score"))


def current_features(nodes: DataFrame, search: Search, query_vector: Column | None = None) -> DataFrame:
    """The features of the current rows of the nodes in scope; ``nodes`` holds all states of nodes.

    Scope filters reach the scan: they hold for all states of a node or for none, since its id names graph and kind.
    """
    rows = in_scope(nodes, search.scope, search.kinds).withColumns({name: F.col(c) for name, c in META.items()})
    found = features(rows, search, query_vector, keep=("updated_at",))
    return current_rows(found, "node_id", "updated_at", {c: c for c in found.columns if c not in ("node_id", "updated_at")})


def statistics(rows: DataFrame, search: Search) -> DataFrame:
    """One row: number of nodes ``n``, average length, and the document frequency of every term."""
    df = [F.count_if(F.col(name) > 0).alias(f"d{name}") for name, _, _ in _terms(search)]
    return rows.agg(F.count("*").alias("n"), (F.sum("length") / F.count("*")).alias("average"), *df)


def _with_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` with the columns of the single row of an ungrouped aggregate, as a scalar subquery."""
    names = one.columns
    held = rows.withColumn("__one", one.select(F.struct(*names)).scalar())
    return held.select(*rows.columns, *[F.col("__one")[n].alias(n) for n in names])


def bm25(search: Search) -> Column:
    """BM25 over the columns of ``corpus`` and ``statistics``, rounded to 6 digits; 0 unless positive."""
    parts = [scoring.bm25_term(F.col(name), F.col(f"d{name}"), F.col("n"), F.col("length"), F.col("average"), m) for name, _, m in _terms(search)]
    raw = _sum(parts)
    return F.when(raw > 0, F.round(raw, 6)).otherwise(F.lit(0.0))


def hits(search: Search) -> Column:
    """How many query terms (repeats count) are substrings of the haystack."""
    return reduce(lambda a, b: a + b, [F.when(F.contains("haystack", F.lit(t)), m).otherwise(0) for t, m in search.distinct_terms.items()], F.lit(0))


def exact(search: Search) -> Column:
    q = F.lower(F.lit(search.query))
    return (F.lower(text.text("name")) == q) | (F.lower(text.text("qualified_name")) == q)


def bm25_scores(found: DataFrame, search: Search) -> DataFrame:
    """``node_id, bm25`` of the features with a positive score. An empty scope gives no rows."""
    return _with_row(found, statistics(found, search)).select("node_id", bm25(search).alias("bm25")).where("bm25 > 0")


def scored(found: DataFrame, search: Search) -> DataFrame:
    """All matches among the features of a scope with ``keyword_score``, ``vector_score``, ``exact_match`` and ``score``.

    Rows without a hit, a BM25 score, a vector score and an exact match drop out. Null texts count as empty, a null
    ``is_public`` as not public.
    """
    rows = _with_row(found, statistics(found, search)).withColumn("bm25", bm25(search))
    rows = rows.where((F.col("hits") > 0) | (F.col("bm25") > 0) | (F.col("vector_score") != 0) | F.col("exact_match"))
    keyword = F.when(F.col("bm25") > 0, F.col("bm25")).otherwise(F.col("hits") / F.lit(max(len(search.terms), 1)))
    rows = rows.withColumn("keyword_score", keyword)
    score = scoring.hybrid(F.col("keyword_score"), F.col("vector_score"), F.col("exact_match"), F.col("is_public"), F.col("kind"))
    return rows.withColumn("score", score).select("node_id", "graph_id", "kind", "name", "qualified_name", text.text("summary").alias("summary"), "source_path", "keyword_score", "vector_score", "exact_match", "score")


ORDER = ("score", "keyword_score", "vector_score", "qualified_name", "node_id")


def best(matches: DataFrame, k: int) -> DataFrame:
    """The first ``k`` by score, keyword score, vector score, qualified name and node id, all descending."""
    return matches.orderBy(*[F.desc(c) for c in ORDER]).limit(k)


def search_candidates(nodes: DataFrame, search: Search, query_vector: Column | None = None) -> DataFrame:
    """The candidate search over all states of nodes. ``query_vector`` is an array expression; without it the vector
    score is 0."""
    return best(scored(current_features(nodes, search, query_vector), search), search.top_k)


def route_graphs(top: DataFrame) -> DataFrame:
    """The best score of each graph among the top rows, at least 0, and its place by it (ties by graph id)."""
    routed = top.groupBy("graph_id").agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"))
    # there are no more graphs than top rows
    return routed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "graph_id")))


def answer(top: DataFrame, search: Search, with_vectors: bool) -> DataFrame:
    """The answer of a candidate search, one row: ``query, requested_graph_id, requested_graph_ids,
    resolved_graph_ids, routed_graphs, candidate_count, top_matches, context_preview, warnings``.

    ``top`` has ``top_k`` rows at most. Routed graphs come best first, matches in the order of ``best``.
    """
    texts = lambda items: F.array(*[F.lit(x) for x in items]).cast("array<string>")
    warnings = () if with_vectors else ("Vector search is disabled because no embedding provider is configured.",)
    cards = F.struct(*[F.col(c) for c in ORDER], F.struct("node_id", "graph_id", "kind", "name", "qualified_name", "summary", "score").alias("card"))
    matches = top.agg(F.count("*").alias("candidate_count"), F.transform(F.sort_array(F.collect_list(cards), asc=False), lambda x: x["card"]).alias("top_matches"))
    routed = route_graphs(top).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "graph_id", "score"))), lambda x: F.struct(x["graph_id"].alias("graph_id"), x["score"].alias("score"))).alias("routed_graphs"))
    shown = _with_row(_with_row(matches, routed), preview(top))
    return shown.select(
        F.lit(search.query).alias("query"), F.lit(search.graph_id).cast("string").alias("requested_graph_id"), texts(search.graph_ids).alias("requested_graph_ids"), texts(search.scope).alias("resolved_graph_ids"),
        "routed_graphs", "candidate_count", "top_matches", "context_preview", texts(warnings).alias("warnings"),
    )


def preview(top: DataFrame, n: int = 3) -> DataFrame:
    """One row: ``kind qualified_name: summary`` of the first rows between bars. ``top`` has k rows at most."""
    item = F.concat_ws("", "kind", F.lit(" "), "qualified_name", F.lit(": "), text.text("summary"))
    order = F.struct(*[F.col(c) for c in ORDER], item.alias("item"))
    items = F.transform(F.sort_array(F.collect_list(order), asc=False), lambda x: x["item"])
    return top.agg(text.compress(F.slice(items, 1, n), n).alias("context_preview"))


def nearest(nodes: DataFrame, search: Search, query_vector: Column) -> DataFrame:
    """Vector scan of the index profile: the ``max(4 top_k, 20)`` nearest of all nodes, the scope only after that.

    ``nodes`` are current rows with embeddings (``searchable``).
    """
    near = nodes.withColumn("vector_score", vector.similarity(query_vector, F.col("embedding"))).where(F.col("embedding").isNotNull())
    near = near.orderBy(F.desc("vector_score"), F.desc("node_id")).limit(max(4 * search.top_k, 20))
    return in_scope(near, search.scope, search.kinds).select("node_id", "vector_score")


def search_by_index(nodes: DataFrame, search: Search, query_vector: Column) -> DataFrame:
    """The search of the index profile over current rows with embeddings: vector scores of the ``nearest`` alone,
    hits of the query's parts between white space, and nodes that do not say so count as public."""
    parts = search.query.lower().split()
    hit = _sum([F.when(F.contains("haystack", F.lit(t)), 1).otherwise(0) for t in parts]).cast("int")
    rows = in_scope(nodes, search.scope, search.kinds).withColumns({"haystack": text.haystack(), "is_public": F.coalesce("is_public", F.lit(True))})
    found = features(rows, search, keep=()).drop("vector_score", "hits").join(rows.select("node_id", hit.alias("hits")), "node_id")
    # at most max(4 top_k, 20) rows
    found = found.join(F.broadcast(nearest(nodes, search, query_vector)), "node_id", "left").withColumn("vector_score", F.coalesce("vector_score", F.lit(0.0)))
    rows = _with_row(found, statistics(found, search)).withColumn("bm25", bm25(search))
    rows = rows.where((F.col("hits") > 0) | (F.col("bm25") > 0) | (F.col("vector_score") != 0) | F.col("exact_match"))
    rows = rows.withColumn("keyword_score", F.when(F.col("bm25") > 0, F.col("bm25")).otherwise(F.col("hits") / F.lit(max(len(parts), 1))))
    score = scoring.hybrid(F.col("keyword_score"), F.col("vector_score"), F.col("exact_match"), F.col("is_public"), F.col("kind"))
    return best(rows.withColumn("score", score), search.top_k)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, *, id_col: str, vector_col: str, k: int, block: int = 256) -> DataFrame:
    """The ``k`` vectors nearest to every query vector by dot product: ``<id>, neighbour, similarity, rank``.

    Queries come in blocks of ``block`` vectors, so that each row of ``vectors`` meets a block in one expression;
    what a task finds is cut to its first ``k`` per query before the shuffle. Null vectors take no part; ties go
    by id.
    """
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("q"), F.col(vector_col).alias("v"))
    n_blocks = max(1, -(-asked.count() // block))
    blocks = asked.groupBy(F.pmod(F.xxhash64("q"), F.lit(n_blocks)).alias("b")).agg(F.collect_list(F.struct("q", "v")).alias("asked"))
    # each block meets the rows in as many parts as keep all cores busy
    parts = max(1, -(-4 * parallelism(vectors.sparkSession) // n_blocks))
    count = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    blocks = blocks.withColumn("part", F.explode(count(parts)))
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("neighbour"), F.col(vector_col).alias("w"))
    rows = rows.withColumns({"b": F.explode(count(n_blocks)), "part": F.pmod(F.xxhash64("neighbour"), F.lit(parts))})
    met = rows.join(blocks, ["b", "part"]).select("neighbour", "w", F.explode("asked").alias("a")).select(F.col("a.q").alias("q"), "neighbour", vector.similarity(F.col("a.v"), F.col("w")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "neighbour"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(id_col), "neighbour", "similarity", "rank")


# ---------------------------------------------------------------- many queries, derived tables


def postings(nodes: DataFrame) -> DataFrame:
    """``graph_id, kind, term, node_id, tf, doc_len`` of all nodes but libraries."""
    rows = in_scope(nodes).select("graph_id", "kind", "node_id", text.words(text.haystack()).alias("tokens"))
    return rows.select("graph_id", "kind", "node_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term")).groupBy("graph_id", "kind", "term", "node_id", "doc_len").agg(F.count("*").cast("int").alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("graph_id", "kind", "term").agg(F.count("*").alias("df"))


def scope_stats(nodes: DataFrame) -> DataFrame:
    return in_scope(nodes).groupBy("graph_id", "kind").agg(F.count("*").alias("n"), F.sum(F.size(text.words(text.haystack()))).alias("total_len"))


def write_index(nodes: DataFrame, path: str) -> None:
    """Store postings and statistics of current node rows below ``path``, for any number of searches.

    Postings lie sorted by term in ranges of it, so that a query's terms read the row groups that have them.
    """
    post = postings(nodes).repartitionByRange("term", "graph_id").sortWithinPartitions("term", "graph_id", "kind")
    post.write.mode("overwrite").parquet(f"{path}/postings")
    stored = nodes.sparkSession.read.parquet(f"{path}/postings")
    term_stats(stored).repartitionByRange("term").sortWithinPartitions("term", "graph_id").write.mode("overwrite").parquet(f"{path}/terms")
    scope_stats(nodes).write.mode("overwrite").parquet(f"{path}/scopes")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored postings, term and scope statistics, as ``bm25_indexed`` takes them."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "scopes"))


def bm25_indexed(post: DataFrame, terms: DataFrame, scopes: DataFrame, search: Search) -> DataFrame:
    """The same scores as ``bm25_scores`` from the derived tables; only the postings of the query's terms are read.

    Counts of nodes, lengths and document frequencies add up over (graph, kind), so they are kept per pair.
    """

    def scoped(df: DataFrame) -> DataFrame:
        df = df.where(F.col("graph_id").isin(*search.scope)) if search.scope else df
        return df.where(F.col("kind").isin(*search.kinds)) if search.kinds else df

    wanted = list(search.distinct_terms)
    total = scoped(scopes).agg(F.sum("n").alias("n"), (F.sum("total_len") / F.sum("n")).alias("average"))
    found = scoped(terms).where(F.col("term").isin(*wanted)).agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("df"))), F.lit(0)).alias(f"d{name}") for name, t, _ in _terms(search)])
    tf = scoped(post).where(F.col("term").isin(*wanted)).groupBy("node_id").agg(F.max("doc_len").alias("length"), *[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(name) for name, t, _ in _terms(search)])
    return _with_row(_with_row(tf, total), found).select("node_id", bm25(search).alias("bm25")).where("bm25 > 0")


#: A term that no text has; each node has it once, so that nodes without an asked term count as well.
LENGTH = ""
#: More than rounding to 6 digits changes a score.
SLACK = 1e-6


class Best:
    """The ``k`` best nodes so far of each query of a block, while nodes come in chunks.

    A query's terms come by descending weight, and scores are sums in this order. What its last terms can add at most
    tells which of the first terms a node must have to come among the best (MaxScore): only the postings of those are
    read, and the last terms are looked up for the nodes that may still do. Nothing is left out by that.
    """

    def __init__(self, queries: pa.Table, k: int, average: float):
        self.ids, self.k, self.average = queries["query_id"].combine_chunks(), k, average
        names = pc.list_flatten(queries["terms"].combine_chunks())
        self.terms = names.unique()
        ends = np.cumsum(pc.list_value_length(queries["terms"]).to_numpy()).tolist()
        codes = pc.index_in(names, value_set=self.terms).to_pylist()
        weights = pc.list_flatten(queries["weights"].combine_chunks()).to_pylist()
        self.asked = [list(zip(codes[a:b], weights[a:b], strict=True)) for a, b in pairwise([0, *ends])]
        self.best: list[list[tuple[float, str]]] = [[] for _ in self.asked]

    def add(self, nodes: pa.Table) -> None:
        """Score nodes ``node_id, doc_len, terms``, a term as often as the text has it."""
        nodes = nodes.select(["node_id", "doc_len", "terms"]).sort_by("node_id").combine_chunks()  # equal scores go by node
        n, lists = len(nodes), nodes["terms"].combine_chunks()
        code = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=self.terms), -1).to_numpy().astype(np.int64)
        key = (code * n + pc.list_parent_indices(lists).to_numpy())[code >= 0]
        key, tf = np.unique(key, return_counts=True)
        if not len(key):
            return
        code, node = key // n, key % n
        length = np.maximum(nodes["doc_len"].to_numpy(), 1)[node]
        impact = tf * (scoring.K1 + 1) / (tf + scoring.K1 * (1 - scoring.B + scoring.B * (length / self.average)))
        first = np.searchsorted(code, np.arange(len(self.terms) + 1))
        most, there = np.zeros(len(self.terms)), np.flatnonzero(np.diff(first))
        most[there] = np.maximum.reduceat(impact, first[there])
        first, most, names, sums = first.tolist(), most.tolist(), nodes["node_id"].to_pylist(), np.zeros(n)
        for q, asked in enumerate(self.asked):
            best = self.best[q]
            least = -best[-1][0] if len(best) == self.k else 0.0
            rest, p = 0.0, len(asked)  # from term p on, the terms add ``rest`` at most
            while p:
                more = max(asked[p - 1][1], 0.0) * most[asked[p - 1][0]]
                if more and rest + more >= least - SLACK:
                    break
                rest, p = rest + more, p - 1
            found = [(node[first[t] : first[t + 1]], w * impact[first[t] : first[t + 1]]) for t, w in asked[:p] if first[t] < first[t + 1]]
            if not found:
                continue
            if len(found) == 1:
                at, score = found[0]
                keep = score >= least - rest - SLACK
                at, score = at[keep], score[keep]
            else:
                for at, score in found:
                    sums[at] += score
                if least:
                    met = np.concatenate([at for at, _ in found])
                    at = np.unique(met[sums[met] >= least - rest - SLACK])
                else:
                    met = at = np.flatnonzero(sums)
                score = sums[at]
                sums[met] = 0.0
            for t, w in asked[p:]:
                if first[t] < first[t + 1] and len(at):
                    own = node[first[t] : first[t + 1]]
                    place = np.minimum(np.searchsorted(own, at), len(own) - 1)
                    has = own[place] == at
                    score[has] += w * impact[first[t] : first[t + 1]][place[has]]
            score = np.floor(score * 1e6 + 0.5) / 1e6
            keep = (score > 0) & (score >= least)
            at, score = at[keep], score[keep]
            if len(at) > self.k:
                kth = np.partition(score, len(score) - self.k)[len(score) - self.k]
                over = np.flatnonzero(score > kth)
                keep = np.concatenate([over, np.flatnonzero(score == kth)[: self.k - len(over)]])
                at, score = at[keep], score[keep]
            if len(at):
                self.best[q] = sorted([*best, *((-s, names[i]) for s, i in zip(score.tolist(), at.tolist(), strict=True))])[: self.k]

    def found(self) -> pa.RecordBatch:
        rows = pa.array(np.repeat(np.arange(len(self.best)), [len(x) for x in self.best]))
        columns = [self.ids.take(rows), pa.array([name for x in self.best for _, name in x], pa.string()), pa.array([-s for x in self.best for s, _ in x], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "node_id", "bm25"])


def _runs(batches: Iterator[pa.RecordBatch], first: int, chunk: int) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by ``step`` as tables of one step: an even step (queries) whole, an odd one (nodes) in chunks."""
    held, step, rows, size, most = [], None, 0, 0, first
    for batch in batches:
        steps = batch.column("step").to_numpy()
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(steps)]):
            if a < b and steps[a] != step:
                if held:
                    yield step, pa.Table.from_batches(held)
                held, step, rows, size, most = [], int(steps[a]), 0, 0, first
            while a < b:
                part = batch.slice(a, min(b - a, most - rows) if step % 2 else b - a)
                held.append(part)
                a, rows, size = a + len(part), rows + len(part), size + part.nbytes
                if step % 2 and (rows >= most or size >= CHUNK_BYTES):
                    yield step, pa.Table.from_batches(held)
                    held, rows, size, most = [], 0, 0, chunk
    if held:
        yield step, pa.Table.from_batches(held)


def _best(k: int, average: float, first: int, chunk: int):
    """A function for ``mapInArrow``: of rows sorted by ``step``, the best nodes of each query of step 2 i among the
    nodes of step 2 i + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, best = None, None
        for at, rows in _runs(batches, first, chunk):
            if at % 2 == 0:
                if best:
                    yield best.found()
                step, best = at, Best(rows, k, average)
            elif at - 1 == step:
                best.add(rows)
        if best:
            yield best.found()

    return run


def batch_bm25(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best nodes by BM25 of every query: ``query_id, node_id, bm25, rank``.

    ``queries`` has ``query_id, query``. One pass over the texts leaves of each node its length and the terms that are
    asked. Blocks of queries meet parts of the nodes; a task holds a block's queries with their best nodes so far while
    the nodes of a part stream through, so that pairs of a query and a node are never rows: only the ``k`` best per
    query and part are shuffled and ranked. Scope is all nodes but libraries.
    """
    spark = nodes.sparkSession
    terms = F.explode(text.words(F.col("query"))).alias("term")
    asked = written(queries.where("query_id is not null and query is not null").select("query_id", terms).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    tokens = in_scope(nodes).select("node_id", text.words(text.haystack()).alias("tokens"))
    each = tokens.select("node_id", F.size("tokens").alias("doc_len"), F.explode(F.concat("tokens", F.array(F.lit(LENGTH)))).alias("term"))
    wanted = written(asked.select("term").union(spark.range(1).select(F.lit(LENGTH).alias("term"))).distinct())
    # else all tokens of all nodes are shuffled
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_TERMS else wanted
    post = written(each.join(wanted, "term", "left_semi").groupBy("node_id", "doc_len").agg(F.array_remove(F.collect_list("term"), LENGTH).alias("terms")))
    n, total = post.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    blocks = max(1, -(-asked.count() // BLOCK))
    parts = max(-(-n // PER_PART), -(-4 * parallelism(spark) // blocks))
    df = post.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    d = F.col("df") * F.col("times")
    idf = F.log(F.lit(1.0) + (F.lit(n) - d + 0.5) / (d + 0.5))
    weighed = asked.join(df, "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((F.col("times") * idf).alias("weight"), "term")), asc=False).alias("asked"))
    # an even step holds a block's queries, the next one the nodes of a part that meet them
    step = lambda block, part, odd: ((block * parts + part) * 2 + odd).cast("long").alias("step")
    count = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    kind = asked.schema["query_id"].dataType.simpleString()
    ask = weighed.select("query_id", "asked", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), count(parts).alias("part"))
    ask = ask.select(step(F.col("block"), F.col("part"), 0), "query_id", F.lit(None).cast("string").alias("node_id"), F.lit(0).alias("doc_len"), F.col("asked.term").alias("terms"), F.col("asked.weight").alias("weights"))
    met = post.where(F.size("terms") > 0).select("*", count(blocks).alias("block"))
    met = met.select(step(F.col("block"), F.pmod(F.xxhash64("node_id"), F.lit(parts)), 1), F.lit(None).cast(kind).alias("query_id"), "node_id", "doc_len", "terms", F.lit(None).cast("array<double>").alias("weights"))
    rows = ask.union(met).repartition(blocks * parts, F.shiftright("step", 1)).sortWithinPartitions("step")
    best = rows.mapInArrow(_best(k, total / n if total else 1.0, FIRST, CHUNK), f"query_id {kind}, node_id string, bm25 double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "node_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
