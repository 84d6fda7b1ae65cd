"""Registered queries of search, details, catalog, text functions, merging and ingest, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import text, vector
from graphweft.operators import catalog, details, search
from graphweft.operators.merge import current_rows
from graphweft.params import Details, Search
from graphweft.session import own_folder, table
from graphweft.sources import embedding, python_api, store
from graphweft.sources import ingest as library_ingest
from graphweft.streaming import ingest

PLAIN = Search("cached engine")
REPEATED = Search("the cache of the cache")
SCOPED = Search("nearest sorted cache", graph_ids=("lumen-core:4.2.0",), kinds=("Function", "Class"), top_k=20)
HYBRID = Search("public cache", top_k=50)
KINDS = ("Class", "Function", "Module")


def _current(spark: SparkSession, d: str, vectors: bool = False) -> DataFrame:
    return search.searchable(table(spark, d, "nodes"), vectors=vectors)


# ---------------------------------------------------------------- scans, text functions


def scan_scope_filter(spark, d):
    rows = search.in_scope(table(spark, d, "nodes"), SCOPED.graph_ids, KINDS)
    return rows.select("node_id", "kind", "line_start").distinct()


def exclude_library(spark, d):
    return search.in_scope(table(spark, d, "nodes")).groupBy("kind").agg(F.count("*").alias("n"))


def haystack_projection(spark, d):
    h = text.haystack()
    return _current(spark, d).select("node_id", F.md5(h).alias("digest"), F.length(h).cast("long").alias("n_chars"))


def _token_counts(spark, d, tokens):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(tokens).cast("long").alias("n"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


def tokenize_words(spark, d):
    return _token_counts(spark, d, text.words(F.col("text")))


def tokenize_ws(spark, d):
    return _token_counts(spark, d, text.blank_separated(F.col("text")))


def tokenize_hash(spark, d):
    return _token_counts(spark, d, text.hash_tokens(F.col("text")))


def slug_graph_id(spark, d):
    return table(spark, d, "registry").select("name", "version", text.graph_id(F.col("name"), F.col("version")).alias("built"), text.package_name(F.col("name")).alias("package"), text.distribution_name(F.col("name")).alias("distribution")).distinct()


def node_identity(spark, d):
    return table(spark, d, "nodes").select("node_id", text.node_id(F.col("graph_id"), F.col("kind"), F.col("qualified_name")).alias("built"), text.last_part(F.col("qualified_name")).alias("last")).distinct()


def summary_first_line(spark, d):
    return table(spark, d, "documents").select("doc_id", text.first_line(F.col("text"), F.lit("(none)")).alias("summary"))


def embedding_texts(spark, d):
    rows = _current(spark, d).where(F.col("kind").isin(*text.EMBEDDABLE))
    return rows.select("node_id", text.embedding_text().alias("plain"), text.embedding_text_keeping_empty().alias("keeping_empty"))


# ---------------------------------------------------------------- BM25 and search


def term_freq(spark, d):
    return search.postings(_current(spark, d)).select("node_id", "term", F.col("tf").cast("long").alias("tf"), F.col("doc_len").cast("long").alias("doc_len"))


def doc_freq(spark, d):
    return search.term_stats(search.postings(_current(spark, d))).groupBy("term").agg(F.sum("df").alias("df"))


def corpus_stats(spark, d):
    return search.scope_stats(_current(spark, d))


def bm25_basic(spark, d):
    return search.bm25_scores(search.current_features(table(spark, d, "nodes"), PLAIN), PLAIN)


def bm25_repeated_terms(spark, d):
    return search.bm25_scores(search.current_features(table(spark, d, "nodes"), REPEATED), REPEATED)


def bm25_scoped(spark, d):
    return search.bm25_scores(search.current_features(table(spark, d, "nodes"), SCOPED), SCOPED)


_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index of a directory's nodes, stored with its first use in an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path = f"{own_folder(spark)}/index-{uuid.uuid4().hex}"
        search.write_index(_current(spark, d), path)
        _INDEXES[key] = path
    return search.read_index(spark, _INDEXES[key])


def bm25_indexed(spark, d):
    return search.bm25_indexed(*_index(spark, d), SCOPED)


def keyword_hits(spark, d):
    return search.current_features(table(spark, d, "nodes"), REPEATED).select("node_id", F.col("hits").cast("long").alias("hits")).where("hits > 0")


def exact_match(spark, d):
    return search.current_features(table(spark, d, "nodes"), Search("Session")).where("exact_match").select("node_id", "kind")


def hybrid_score(spark, d):
    rows = search.scored(search.current_features(table(spark, d, "nodes"), HYBRID, embedding.hash_vector(F.lit(HYBRID.query))), HYBRID)
    return rows.select("node_id", F.round("keyword_score", 6).alias("keyword_score"), "vector_score", "exact_match", "score")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("node_id", "graph_id", "kind", "name", "qualified_name", "summary", F.round("keyword_score", 6).alias("keyword_score"), "vector_score", "score")


def search_candidates_keyword(spark, d):
    return _shown(search.search_candidates(table(spark, d, "nodes"), PLAIN))


def search_candidates_hybrid(spark, d):
    return _shown(search.search_candidates(table(spark, d, "nodes"), HYBRID, embedding.hash_vector(F.lit(HYBRID.query))))


def search_candidates_scoped(spark, d):
    return _shown(search.search_candidates(table(spark, d, "nodes"), SCOPED))


def vector_overfetch_then_filter(spark, d):
    return search.nearest(_current(spark, d, True), Search("public cache", kinds=("Function",)), embedding.hash_vector(F.lit("public cache")))


def route_graphs(spark, d):
    return search.route_graphs(search.search_candidates(table(spark, d, "nodes"), Search(PLAIN.query, top_k=50)))


def search_by_index(spark, d):
    rows = search.search_by_index(_current(spark, d, True), HYBRID, embedding.hash_vector(F.lit(HYBRID.query)))
    return rows.select("node_id", F.round("keyword_score", 6).alias("keyword_score"), "vector_score", "score")


def candidates_answer(spark, d):
    asked = Search(PLAIN.query, top_k=50)
    got = search.answer(search.search_candidates(table(spark, d, "nodes"), asked), asked, with_vectors=False)
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), " ")
    return got.select("query", "candidate_count", names("routed_graphs", "graph_id").alias("routed"), names("top_matches", "node_id").alias("matches"), "context_preview", F.size("warnings").cast("long").alias("n_warnings"))


def preview_compress(spark, d):
    return search.preview(search.search_candidates(table(spark, d, "nodes"), PLAIN))


def batch_search(spark, d):
    asked = table(spark, d, "documents").where("pmod(doc_id, 50) = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    # plain arithmetic: decimal and binary rounding disagree on scores that end in a half
    return search.batch_bm25(_current(spark, d), asked, 5).select("query_id", "rank", "node_id", (F.floor(F.col("bm25") * 1e4 + 0.5) / 1e4).alias("bm25"))


# ---------------------------------------------------------------- vectors


def hash_embedding_cells(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(text.hash_tokens(F.col("text"))).alias("t"))
    return rows.groupBy("doc_id", vector.bucket(F.col("t")).alias("bucket")).agg(F.count("*").alias("n"))


def hash_embedding(spark, d):
    rows = _current(spark, d).where(F.col("kind").isin(*text.EMBEDDABLE))
    e = embedding.embed_nodes_hashed(rows)
    return e.select("node_id", F.posexplode("embedding").alias("i", "x"))


def l2_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vector.l2_norm(F.col("embedding")), 6).alias("norm"))


def cosine_topk(spark, d):
    """The 20 nearest of every vector whose id is divisible by 50, itself included."""
    vecs = table(spark, d, "embeddings")
    return search.nearest_of_each(vecs, vecs.where("pmod(vec_id, 50) = 0"), id_col="vec_id", vector_col="embedding", k=20)


def cosine_dim_guard(spark, d):
    rows = _current(spark, d, True).where("kind <> 'Library'")
    q = F.array(*[F.lit(0.1)] * vector.DIMENSIONS)
    return rows.select("node_id", vector.similarity(q, F.col("embedding")).alias("similarity"))


# ---------------------------------------------------------------- details, catalog


def _request(spark, d) -> DataFrame:
    """The ids of a batch lookup: the ends of the graph's inheritance links, of which many have no node."""
    ends = table(spark, d, "edges").where(F.upper(F.trim("type")) == "INHERITS").select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))
    return ends.where("node_id is not null").distinct()


def nodes_by_ids(spark, d):
    """A lookup of all ends of the inheritance links."""
    columns = ("graph_id", "kind", "name", "qualified_name", "signature", "docstring", "logic_skeleton", "source_excerpt")
    rows = table(spark, d, "nodes").join(_request(spark, d), "node_id", "left_semi")
    return details.shown(current_rows(rows, "node_id", "updated_at", {c: c for c in columns}), Details(("all",)))


def induced_edges(spark, d):
    return details.induced_edges(table(spark, d, "edges"), _request(spark, d))


def missing_ids(spark, d):
    asked = table(spark, d, "edges").select(F.col("edge_id").alias("pos"), F.col("target_node_id").alias("node_id")).where("node_id <> ''")
    return details.missing_ids(asked, table(spark, d, "nodes"))


def details_context(spark, d):
    rows = current_rows(table(spark, d, "nodes"), "node_id", "updated_at", {c: c for c in ("graph_id", "kind", "qualified_name", "docstring", "logic_skeleton", "signature")})
    return details.context(details.in_requests(rows)).select("graph_id", "request", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n_chars"))


def details_metadata(spark, d):
    """Place and metadata of every node, as a lookup of details shows them."""
    fields = ("is_async", "is_method", "returns_annotation", "annotation", "position", "parameter_kind", "origin", "example_source")
    rows = current_rows(table(spark, d, "nodes"), "node_id", "updated_at", {**{c: c for c in ("source_path", "line_start", "line_end")}, **{c: f"metadata.{c}" for c in fields}})
    return rows.select("node_id", "source_path", "line_start", "line_end", *fields)


def counts_by_kind7(spark, d):
    return catalog.counts_by_kind(_current(spark, d))


def counts_by_kind4(spark, d):
    return catalog.counts_by_kind(_current(spark, d), catalog.FOUR)


def _libraries(spark, d) -> DataFrame:
    return current_rows(table(spark, d, "nodes"), "node_id", "updated_at", {"graph_id": "graph_id", "kind": "kind", "name": "name", "version": "metadata.version", "status": "metadata.status", "updated_at": "updated_at"})


def list_graphs(spark, d):
    return catalog.list_graphs(_libraries(spark, d))


def catalog_prefix_status(spark, d):
    return catalog.list_graphs(_libraries(spark, d), name_prefix="L", status="building", limit=20)


def catalog_with_status(spark, d):
    fields = {c: c for c in ("graph_id", "kind", "name", "updated_at")} | {c: f"metadata.{c}" for c in ("version", "status", "embedding", "embedding_provider", "embedding_model", "embedding_schema_version")}
    return catalog.catalog(current_rows(table(spark, d, "nodes"), "node_id", "updated_at", fields)).drop("updated_at")


def details_answers(spark, d):
    """Lookups of the ends of all inheritance links, about 50 ids each: what they answer."""
    nodes = current_rows(table(spark, d, "nodes"), "node_id", "updated_at", {c: c for c in ("graph_id", "kind", "name", "qualified_name", "signature", "docstring", "logic_skeleton", "source_excerpt")})
    asked = details.in_requests(_request(spark, d).withColumn("graph_id", F.lit("all"))).select("request", F.col("node_id").alias("pos"), "node_id")
    got = details.answers(nodes, table(spark, d, "edges"), asked, Details(("all",)))
    return got.select("request", F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"), F.md5("expanded_context").alias("digest"), F.array_join("missing_node_ids", " ").alias("missing"))


def embedding_status(spark, d):
    fields = {"graph_id": "graph_id", **{c: f"metadata.{c}" for c in ("embedding", "embedding_provider", "embedding_model", "embedding_schema_version")}}
    return catalog.embedding_status(current_rows(table(spark, d, "nodes"), "node_id", "updated_at", fields))


def embedding_dimensions(spark, d):
    return catalog.embedding_dimensions(current_rows(table(spark, d, "nodes"), "node_id", "updated_at", {"graph_id": "graph_id", "embedding": "metadata.embedding"}))


def rebuild_counts(spark, d):
    return catalog.rebuild_counts(current_rows(table(spark, d, "nodes"), "node_id", "updated_at", {"graph_id": "graph_id", "kind": "kind", "embedding": "metadata.embedding"}))


def candidate_name_filter(spark, d):
    names = table(spark, d, "registry").select("name").distinct().withColumn("rank", catalog.name_filter(F.col("name"), "li"))
    return names.where("rank is not null").orderBy("rank", F.lower("name"), "name").limit(20)


def health(spark, d):
    return catalog.health(table(spark, d, "nodes"), table(spark, d, "edges"))


# ---------------------------------------------------------------- merging, links, ingest


def node_merge_last_wins(spark, d):
    return store.merged_nodes(table(spark, d, "nodes").select("node_id", "kind", "summary", "line_start", "updated_at")).select("node_id", "kind", "summary", "line_start")


def edge_merge_distinct(spark, d):
    return table(spark, d, "edges").select("source_node_id", F.upper(F.trim("type")).alias("type"), "target_node_id").distinct()


def edge_endpoint_resolve(spark, d):
    return store.resolved_edges(table(spark, d, "edges"), table(spark, d, "nodes")).select("source_node_id", "type", "target_node_id")


def registry_upsert(spark, d):
    rows = table(spark, d, "registry").select("graph_id", "name", "version", "status", "registered_at")
    late = rows.where("registered_at >= '2024-01-01'")
    return store.registered(rows.where("registered_at < '2024-01-01'"), late).select("graph_id", "name", "version")


def khop_expand(spark, d):
    start = table(spark, d, "nodes").where("kind = 'Library'").select("node_id")
    return details.expand(table(spark, d, "edges"), start, 2).select("node_id", F.col("distance").cast("int").alias("distance"))


def inherits_edges(spark, d):
    rows = current_rows(table(spark, d, "nodes"), "node_id", "updated_at", {"graph_id": "graph_id", "kind": "kind", "name": "name", "bases": "metadata.bases"})
    return details.inherits(rows)


def _sources(spark, d) -> DataFrame:
    files = table(spark, d, "source_files").where(F.lower("source_path").rlike(r"\.pyi?$"))
    rows = files.groupBy("graph_id", F.col("source_path").alias("path")).agg(F.max_by(F.struct(F.col("module_name").alias("module"), F.col("source_text").alias("source")), F.struct("fetched_at", "file_id")).alias("f"))
    return rows.select("graph_id", "path", "f.module", "f.source")


def ingest_counts(spark, d):
    """All Python sources ingested end to end: parsed, embedded, stored, registered; the counts of each graph."""
    files = table(spark, d, "source_files").select("graph_id", F.col("library_name").alias("library")).where("graph_id is not null").groupBy("graph_id").agg(F.max("library").alias("library"))
    path = f"{own_folder(spark)}/ingest-{uuid.uuid4().hex}"
    return library_ingest.ingest(_sources(spark, d).join(files, "graph_id"), path, library_ingest.Ingest()).drop("warnings")


def rebuild_embeddings(spark, d):
    """Current nodes into a store, their embeddings built anew there: what was embedded and skipped of each graph."""
    path = f"{own_folder(spark)}/rebuild-{uuid.uuid4().hex}"
    columns = {c: c for c in ("graph_id", "kind", "qualified_name", "summary", "signature", "docstring")}
    nodes = current_rows(table(spark, d, "nodes"), "node_id", "updated_at", columns | {"embedding": "metadata.embedding"})
    store.replace_graphs(nodes, f"{path}/nodes")
    return library_ingest.rebuild_embeddings(spark, path, library_ingest.Ingest())


def declared_identity(spark, d):
    """Name and version that project files, packaging metadata or a package's version declare."""
    files = table(spark, d, "source_files").select("graph_id", F.col("source_path").alias("path"), F.col("source_text").alias("source"))
    return library_ingest.library_identity(files)


def parse_nodes(spark, d):
    files = _sources(spark, d)
    return python_api.api_nodes(python_api.api_facts(files), files).select("node_id", "graph_id", "kind", "name", "qualified_name", "source_path", "line_start", "line_end", "summary", "docstring", "signature", "logic_skeleton", "source_excerpt")


def parse_edges(spark, d):
    return python_api.api_edges(python_api.api_facts(_sources(spark, d)))


def parse_warnings(spark, d):
    return python_api.api_facts(_sources(spark, d)).where("warning is not null").select("graph_id", "path", "warning")


def stream_link_counts(spark, d):
    """All links as a stream of files, counted per day of their load and type."""
    path = f"{own_folder(spark)}/counts-{uuid.uuid4().hex}"
    links = table(spark, d, "edges")
    one_file = links.inputFiles()[0].endswith("/edges.parquet")
    inbox, names = (d, "edges.parquet") if one_file else (f"{d}/edges.parquet", "*")
    ingest.count_arrivals(spark, inbox, links.schema, f"{path}/table", f"{path}/checkpoint", "1 day", names).awaitTermination()
    return ingest.arrival_counts(spark, f"{path}/table").select(F.date_format("starts_at", "yyyy-MM-dd").alias("day"), "type", "n")


def library_identity(spark, d):
    """Name and version that a library's own files declare; project files before modules, then by path."""
    t = F.col("source_text")
    rows = table(spark, d, "source_files").where("source_text is not null").select("library_name", "source_path", (F.lower("source_path").endswith(".toml")).alias("project"), text.declared_name(t).alias("name"), text.declared_version(t).alias("version"))
    rows = rows.where("(project and name is not null) or version is not null")
    first = F.struct((~F.col("project")).alias("module"), "source_path", "name", "version")
    return rows.groupBy("library_name").agg(F.min(first).alias("f")).select("library_name", F.when(~F.col("f.module"), F.col("f.name")).alias("name"), "f.version")


def candidate_cards_json(spark, d):
    card = F.struct("node_id", "kind", "qualified_name", "summary")
    return search.search_candidates(table(spark, d, "nodes"), PLAIN).select("node_id", F.to_json(card).alias("card"))


def replace_graph(spark, d):
    """All links into a store, then one graph replaced by its ownership links alone; what the store holds then."""
    path = f"{own_folder(spark)}/store-{uuid.uuid4().hex}"
    rows = table(spark, d, "edges").select("graph_id", "source_node_id", "target_node_id", F.upper(F.trim("type")).alias("type")).distinct()
    store.replace_graphs(rows.where("graph_id <> ''"), path)
    one = rows.where("graph_id = 'lumen-core:4.2.0' and type in ('CONTAINS', 'DECLARES')")
    store.replace_graphs(one, path)
    return store.read_graphs(spark, path).groupBy("graph_id", "type").agg(F.count("*").alias("n"))


OWN = (
    scan_scope_filter, exclude_library, haystack_projection, tokenize_words, tokenize_ws, tokenize_hash, slug_graph_id, node_identity, summary_first_line, embedding_texts,
    term_freq, doc_freq, corpus_stats, bm25_basic, bm25_repeated_terms, bm25_scoped, bm25_indexed, keyword_hits, exact_match, hybrid_score,
    search_candidates_keyword, search_candidates_hybrid, search_candidates_scoped, vector_overfetch_then_filter, search_by_index, route_graphs, candidates_answer, preview_compress, batch_search,
    hash_embedding_cells, hash_embedding, l2_norm, cosine_topk, cosine_dim_guard, nodes_by_ids, induced_edges, missing_ids, details_context, details_metadata,
    counts_by_kind7, counts_by_kind4, list_graphs, catalog_prefix_status, embedding_status, embedding_dimensions, rebuild_counts, candidate_name_filter, health,
    node_merge_last_wins, edge_merge_distinct, edge_endpoint_resolve, registry_upsert, khop_expand, inherits_edges, parse_nodes, parse_edges, parse_warnings, ingest_counts, rebuild_embeddings, declared_identity, catalog_with_status, details_answers, replace_graph, stream_link_counts, library_identity, candidate_cards_json,
)


def queries() -> dict:
    return {q.__name__: q for q in OWN}


# ---------------------------------------------------------------- SQL

_CUR = """cur AS (
    SELECT node_id, unnest(r) FROM (SELECT node_id, arg_max({'graph_id': graph_id, 'kind': kind, 'name': name, 'qualified_name': qualified_name, 'source_path': source_path,
        'summary': summary, 'docstring': docstring, 'signature': signature, 'logic_skeleton': logic_skeleton, 'source_excerpt': source_excerpt, 'is_public': is_public, 'line_start': line_start, 'updated_at': updated_at, 'version': metadata.version, 'status': metadata.status,
        'bases': metadata.bases, 'embedding': metadata.embedding, 'embedding_text': metadata.embedding_text, 'embedding_provider': metadata.embedding_provider, 'embedding_model': metadata.embedding_model,
        'embedding_schema_version': metadata.embedding_schema_version}, updated_at) AS r FROM nodes WHERE node_id IS NOT NULL GROUP BY node_id))"""
_HAY = "lower(concat(coalesce(name, ''), ' ', coalesce(qualified_name, ''), ' ', coalesce(summary, ''), ' ', coalesce(docstring, ''), ' ', coalesce(signature, ''), ' ', coalesce(embedding_text, '')))"
_TOK = f"tok AS (SELECT *, {_HAY} AS hay, regexp_extract_all({_HAY}, '[a-zA-Z0-9_]+') AS tokens FROM cur WHERE kind <> 'Library')"
_EMBED = "('Module', 'Class', 'Function', 'Example')"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _scope(s: Search) -> str:
    parts = ["true"] + ([f"graph_id IN {_in(s.graph_ids)}"] if s.graph_ids else []) + ([f"kind IN {_in(s.kinds)}"] if s.kinds else [])
    return " AND ".join(parts)


def _vec(query: str) -> str:
    buckets = f"list_transform(list_filter(regexp_split_to_array(translate(lower('{query}'), '|(),', '    '), '\\s+'), lambda x: x <> ''), lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 32)"
    return f"qv AS (SELECT list_transform(c, lambda x: round(x / sqrt(list_sum(list_transform(c, lambda y: y * y))), 6)) AS q FROM (SELECT list_transform(range(32), lambda i: CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE)) AS c FROM (SELECT {buckets} AS b)))"


_SIM = "CASE WHEN q IS NOT NULL AND embedding IS NOT NULL AND len(q) > 0 AND len(q) = len(embedding) THEN coalesce(nullif(round(list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] * embedding[i])), 6), CAST('nan' AS DOUBLE)), 0.0) ELSE 0.0 END"


def _scored(s: Search, with_vector: bool = False) -> str:
    """CTEs up to ``scored``: the score of every row in scope."""
    terms = list(enumerate(s.distinct_terms.items()))
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) AS t{i}" for i, (t, _) in terms)
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i, _ in terms)
    part = " + ".join(f"CASE WHEN t{i} > 0 THEN {float(m)} * ln(1.0 + (n - d{i} * {m} + 0.5) / (d{i} * {m} + 0.5)) * (t{i} * 2.5 / (t{i} + 1.5 * (0.25 + 0.75 * (greatest(length, 1) / average)))) ELSE 0.0 END" for i, (_, m) in terms)
    hit = " + ".join(f"CASE WHEN contains(hay, '{t}') THEN {m} ELSE 0 END" for _, (t, m) in terms)
    q = s.query.lower()
    return f"""WITH {_CUR}, {_TOK}, {_vec(s.query)},
        fr AS (SELECT *, len(tokens) AS length, {tf} FROM tok WHERE {_scope(s)}),
        st AS (SELECT count(*) AS n, sum(length) / count(*) AS average, {df} FROM fr),
        sc AS (SELECT *, 0.0 + {part} AS raw, {hit} AS hits, (lower(coalesce(name, '')) = '{q}' OR lower(coalesce(qualified_name, '')) = '{q}') AS exact_match, {_SIM if with_vector else "0.0"} AS vector_score FROM fr, st, qv),
        bm AS (SELECT *, CASE WHEN raw > 0 THEN round(raw, 6) ELSE 0.0 END AS bm25 FROM sc),
        kw AS (SELECT *, CASE WHEN bm25 > 0 THEN bm25 ELSE hits / {max(len(s.terms), 1)} END AS keyword_score FROM bm WHERE hits > 0 OR bm25 > 0 OR vector_score <> 0 OR exact_match),
        scored AS (SELECT *, floor((keyword_score * 0.65 + vector_score * 0.35 + CASE WHEN exact_match THEN 0.2 ELSE 0.0 END + CASE WHEN coalesce(is_public, false) THEN 0.05 ELSE 0.0 END + CASE WHEN kind IN ('Function', 'Class') THEN 0.03 ELSE 0.0 END) * 1e6 + 0.5) / 1e6 AS score FROM kw)"""


def _top(s: Search, with_vector: bool = False) -> str:
    return _scored(s, with_vector) + f", top AS (SELECT * FROM scored ORDER BY score DESC, keyword_score DESC, vector_score DESC, qualified_name DESC, node_id DESC LIMIT {s.top_k})"


_SHOWN = " SELECT node_id, graph_id, kind, name, qualified_name, coalesce(summary, '') AS summary, round(keyword_score, 6) AS keyword_score, CAST(vector_score AS DOUBLE) AS vector_score, score FROM top"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_POST = "post AS (SELECT graph_id, kind, node_id, len(tokens) AS doc_len, unnest(tokens) AS term FROM tok), tf AS (SELECT graph_id, kind, term, node_id, doc_len, count(*) AS tf FROM post GROUP BY ALL)"
_LISTED = """ SELECT l.graph_id, name, version, status, coalesce(modules, 0) AS modules, coalesce(classes, 0) AS classes, coalesce(functions, 0) AS functions, coalesce(examples, 0) AS examples
    FROM (SELECT graph_id, name, coalesce(version, 'unknown') AS version, coalesce(status, 'active') AS status, updated_at FROM cur WHERE kind = 'Library' AND {} ORDER BY updated_at DESC, graph_id LIMIT {}) l
    LEFT JOIN (SELECT graph_id, count(*) FILTER (kind = 'Module') AS modules, count(*) FILTER (kind = 'Class') AS classes, count(*) FILTER (kind = 'Function') AS functions, count(*) FILTER (kind = 'Example') AS examples FROM cur GROUP BY graph_id) c USING (graph_id)"""


def _counted(tokens: str) -> str:
    return f"SELECT doc_id, len({tokens}) AS n, len(list_distinct({tokens})) AS n_distinct FROM documents WHERE text IS NOT NULL"


_HASHTOK = "list_filter(regexp_split_to_array(translate(lower({}), '|(),', '    '), '\\s+'), lambda x: x <> '')"
_PARTS = "[coalesce(kind, ''), coalesce(qualified_name, ''), coalesce(summary, ''), coalesce(signature, ''), coalesce(docstring, '')]"
_REQ = "req AS (SELECT DISTINCT node_id FROM (SELECT unnest([source_node_id, target_node_id]) AS node_id FROM edges WHERE upper(trim(type)) = 'INHERITS') WHERE node_id IS NOT NULL)"


def oracle_sql() -> dict[str, str]:
    nine = "count(*) FILTER (kind = '{}') AS {}"
    seven = ", ".join(nine.format(k, c) for c, k in catalog.SEVEN.items())
    four = ", ".join(nine.format(k, c) for c, k in catalog.FOUR.items())
    with_cur, with_tok = f"WITH {_CUR} ", f"WITH {_CUR}, {_TOK}"
    plain50 = Search(PLAIN.query, top_k=50)
    return {
        "scan_scope_filter": f"SELECT DISTINCT node_id, kind, line_start FROM nodes WHERE kind <> 'Library' AND graph_id IN {_in(SCOPED.graph_ids)} AND kind IN {_in(KINDS)}",
        "exclude_library": "SELECT kind, count(*) AS n FROM nodes WHERE kind <> 'Library' GROUP BY kind",
        "haystack_projection": with_cur + f"SELECT node_id, md5({_HAY}) AS digest, length({_HAY}) AS n_chars FROM cur",
        "tokenize_words": _counted("regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')"),
        "tokenize_ws": _counted("list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"),
        "tokenize_hash": _counted(_HASHTOK.format("text")),
        "slug_graph_id": f"""SELECT DISTINCT name, version, concat_ws(':', coalesce(nullif(regexp_replace(regexp_replace(lower({_STRIP.format("name")}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown'), coalesce(nullif({_STRIP.format("version")}, ''), 'unknown')) AS built,
            translate(name, '-', '_') AS package, lower(regexp_replace(name, '[-_.]+', '-', 'g')) AS distribution FROM registry""",
        "node_identity": "SELECT DISTINCT node_id, concat_ws(':', graph_id, kind, qualified_name) AS built, regexp_extract(qualified_name, '[^.]*$') AS last FROM nodes",
        "summary_first_line": f"SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[1], '(none)') AS summary FROM documents",
        "embedding_texts": with_cur + f"SELECT node_id, {_STRIP.format(f"array_to_string(list_filter({_PARTS}, lambda x: x <> ''), ' | ')")} AS plain, regexp_replace(array_to_string({_PARTS}, ' | '), '^[ |]+|[ |]+$', '', 'g') AS keeping_empty FROM cur WHERE kind IN {_EMBED}",
        "term_freq": with_tok + f", {_POST} SELECT node_id, term, tf, doc_len FROM tf",
        "doc_freq": with_tok + f", {_POST} SELECT term, count(*) AS df FROM tf GROUP BY term",
        "corpus_stats": with_tok + " SELECT graph_id, kind, count(*) AS n, CAST(sum(len(tokens)) AS BIGINT) AS total_len FROM tok GROUP BY ALL",
        "bm25_basic": _scored(PLAIN) + " SELECT node_id, bm25 FROM bm WHERE bm25 > 0",
        "bm25_repeated_terms": _scored(REPEATED) + " SELECT node_id, bm25 FROM bm WHERE bm25 > 0",
        "bm25_scoped": _scored(SCOPED) + " SELECT node_id, bm25 FROM bm WHERE bm25 > 0",
        "bm25_indexed": _scored(SCOPED) + " SELECT node_id, bm25 FROM bm WHERE bm25 > 0",
        "keyword_hits": _scored(REPEATED) + " SELECT node_id, CAST(hits AS BIGINT) AS hits FROM sc WHERE hits > 0",
        "exact_match": with_cur + "SELECT node_id, kind FROM cur WHERE kind <> 'Library' AND (lower(name) = 'session' OR lower(qualified_name) = 'session')",
        "hybrid_score": _scored(HYBRID, True) + " SELECT node_id, round(keyword_score, 6) AS keyword_score, CAST(vector_score AS DOUBLE) AS vector_score, exact_match, score FROM scored",
        "search_candidates_keyword": _top(PLAIN) + _SHOWN,
        "search_candidates_hybrid": _top(HYBRID, True) + _SHOWN,
        "search_candidates_scoped": _top(SCOPED) + _SHOWN,
        "vector_overfetch_then_filter": f"WITH {_CUR}, {_vec('public cache')} SELECT node_id, vector_score FROM (SELECT *, {_SIM} AS vector_score FROM cur, qv WHERE embedding IS NOT NULL ORDER BY vector_score DESC, node_id DESC LIMIT 32) WHERE kind = 'Function'",
        "route_graphs": _top(plain50) + " SELECT graph_id, greatest(0.0, max(score)) AS score, CAST(row_number() OVER (ORDER BY greatest(0.0, max(score)) DESC, graph_id) AS INTEGER) AS rank FROM top GROUP BY graph_id",
        "candidates_answer": _top(plain50) + f""", routed AS (SELECT graph_id, max(score) AS score FROM top GROUP BY graph_id), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, keyword_score DESC, vector_score DESC, qualified_name DESC, node_id DESC) AS rn FROM top)
            SELECT '{plain50.query}' AS query, (SELECT count(*) FROM top) AS candidate_count, (SELECT string_agg(graph_id, ' ' ORDER BY score DESC, graph_id) FROM routed) AS routed, (SELECT string_agg(node_id, ' ' ORDER BY rn) FROM o) AS matches,
                (SELECT string_agg(concat(kind, ' ', qualified_name, ': ', coalesce(summary, '')), ' | ' ORDER BY rn) FROM o WHERE rn <= 3) AS context_preview, CAST(1 AS BIGINT) AS n_warnings""",
        "search_by_index": f"""{_scored(HYBRID)}, near AS (SELECT node_id, vs FROM (SELECT node_id, kind, {_SIM} AS vs FROM cur, qv WHERE embedding IS NOT NULL ORDER BY vs DESC, node_id DESC LIMIT {max(4 * HYBRID.top_k, 20)}) WHERE kind <> 'Library'),
            prof AS (SELECT b.*, coalesce(vs, 0.0) AS near_score, {" + ".join(f"CASE WHEN contains(hay, '{t}') THEN 1 ELSE 0 END" for t in HYBRID.query.lower().split())} AS parts FROM bm b LEFT JOIN near USING (node_id)),
            pk AS (SELECT *, CASE WHEN bm25 > 0 THEN bm25 ELSE parts / {len(HYBRID.query.split())} END AS ks FROM prof WHERE parts > 0 OR bm25 > 0 OR near_score <> 0 OR exact_match),
            ps AS (SELECT *, floor((ks * 0.65 + near_score * 0.35 + CASE WHEN exact_match THEN 0.2 ELSE 0.0 END + CASE WHEN coalesce(is_public, true) THEN 0.05 ELSE 0.0 END + CASE WHEN kind IN ('Function', 'Class') THEN 0.03 ELSE 0.0 END) * 1e6 + 0.5) / 1e6 AS total FROM pk)
            SELECT node_id, round(ks, 6) AS keyword_score, CAST(near_score AS DOUBLE) AS vector_score, total AS score FROM ps ORDER BY total DESC, ks DESC, near_score DESC, qualified_name DESC, node_id DESC LIMIT {HYBRID.top_k}""",
        "preview_compress": _top(PLAIN) + " SELECT array_to_string(list_slice(list(concat(kind, ' ', qualified_name, ': ', coalesce(summary, '')) ORDER BY score DESC, keyword_score DESC, vector_score DESC, qualified_name DESC, node_id DESC), 1, 3), ' | ') AS context_preview FROM top",
        "batch_search": with_tok + f""", {_POST}, asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT doc_id AS query_id, unnest(regexp_extract_all(lower(title), '[a-zA-Z0-9_]+')) AS term FROM documents WHERE doc_id % 50 = 0) GROUP BY ALL),
            dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, sum(len(tokens)) / count(*) AS average FROM tok),
            sums AS (SELECT query_id, node_id, round(sum(times * ln(1.0 + (n - df * times + 0.5) / (df * times + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (greatest(doc_len, 1) / average))))), 6) AS bm25 FROM asked JOIN dfs USING (term) JOIN tf USING (term), st GROUP BY ALL),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, node_id) AS rank FROM sums WHERE bm25 > 0)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, node_id, round(bm25, 4) AS bm25 FROM ranked WHERE rank <= 5""",
        "hash_embedding_cells": f"SELECT doc_id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 32 AS INTEGER) AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({_HASHTOK.format('text')}) AS t FROM documents WHERE text IS NOT NULL) GROUP BY ALL",
        "hash_embedding": with_cur + f""", txt AS (SELECT node_id, {_STRIP.format(f"array_to_string(list_filter({_PARTS}, lambda x: x <> ''), ' | ')")} AS t FROM cur WHERE kind IN {_EMBED}),
            b AS (SELECT node_id, list_transform({_HASHTOK.format("t")}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 32) AS b FROM txt), c AS (SELECT node_id, list_transform(range(32), lambda i: CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE)) AS c FROM b),
            e AS (SELECT node_id, c, sqrt(list_sum(list_transform(c, lambda y: y * y))) AS norm FROM c)
            SELECT node_id, CAST(unnest(range(32)) AS INTEGER) AS i, unnest(list_transform(c, lambda x: CASE WHEN norm > 0 THEN round(x / norm, 6) ELSE 0.0 END)) AS x FROM e""",
        "l2_norm": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings",
        "cosine_topk": """WITH s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
            SELECT vec_id, neighbour, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS rank FROM s) WHERE rank <= 20""",
        "cosine_dim_guard": f"WITH {_CUR}, qv AS (SELECT list_transform(range(32), lambda i: CAST(0.1 AS DOUBLE)) AS q) SELECT node_id, CAST({_SIM} AS DOUBLE) AS similarity FROM cur, qv WHERE kind <> 'Library'",
        "nodes_by_ids": f"WITH {_CUR}, {_REQ} SELECT node_id, graph_id, kind, name, qualified_name, signature, docstring, logic_skeleton, CAST(NULL AS VARCHAR) AS source_excerpt FROM cur WHERE node_id IN (SELECT node_id FROM req)",
        "induced_edges": f"WITH {_REQ} SELECT DISTINCT source_node_id, target_node_id, type FROM edges WHERE source_node_id IN (SELECT node_id FROM req) AND target_node_id IN (SELECT node_id FROM req)",
        "missing_ids": "SELECT edge_id AS pos, target_node_id AS node_id FROM edges WHERE target_node_id <> '' AND target_node_id NOT IN (SELECT node_id FROM nodes)",
        "details_context": with_cur + """, n AS (SELECT graph_id, CAST(ceil(count(*) / 50) AS BIGINT) AS requests FROM cur GROUP BY graph_id),
            said AS (SELECT graph_id, ('0x' || substr(md5(node_id), 1, 8))::BIGINT % requests AS request, node_id, concat(kind, ' ', qualified_name, ': ', coalesce(nullif(docstring, ''), nullif(logic_skeleton, ''), nullif(signature, ''), '')) AS item
                FROM cur JOIN n USING (graph_id)),
            j AS (SELECT graph_id, request, array_to_string(list_filter(list_transform(list(item ORDER BY node_id), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' | ') AS context FROM said GROUP BY graph_id, request)
            SELECT graph_id, request, md5(context) AS digest, length(context) AS n_chars FROM j""",
        "details_metadata": """SELECT node_id, unnest(r) FROM (SELECT node_id, arg_max({'source_path': source_path, 'line_start': line_start, 'line_end': line_end, 'is_async': metadata.is_async, 'is_method': metadata.is_method,
            'returns_annotation': metadata.returns_annotation, 'annotation': metadata.annotation, 'position': metadata.position, 'parameter_kind': metadata.parameter_kind, 'origin': metadata.origin, 'example_source': metadata.example_source}, updated_at) AS r
            FROM nodes WHERE node_id IS NOT NULL GROUP BY node_id)""",
        "embedding_dimensions": with_cur + """, f AS (SELECT graph_id, arg_min(len(embedding), node_id) AS dimensions FROM cur WHERE embedding IS NOT NULL GROUP BY graph_id)
            SELECT c.graph_id, any_value(dimensions) AS dimensions, count(*) FILTER (len(embedding) <> dimensions) AS n_other FROM cur c JOIN f ON c.graph_id IS NOT DISTINCT FROM f.graph_id WHERE embedding IS NOT NULL GROUP BY c.graph_id""",
        "stream_link_counts": "SELECT strftime(loaded_at, '%Y-%m-%d') AS day, upper(trim(type)) AS type, count(*) AS n FROM edges WHERE loaded_at IS NOT NULL GROUP BY ALL",
        "counts_by_kind7": with_cur + f"SELECT graph_id, {seven} FROM cur GROUP BY graph_id",
        "counts_by_kind4": with_cur + f"SELECT graph_id, {four} FROM cur GROUP BY graph_id",
        "list_graphs": with_cur + _LISTED.format("true", 50),
        "catalog_prefix_status": with_cur + _LISTED.format("lower(name) LIKE 'l%' AND coalesce(status, 'active') = 'building'", 20),
        "embedding_status": with_cur + "SELECT graph_id, coalesce(bool_or(embedding IS NOT NULL), false) AS ready, " + ", ".join(f"arg_min_null({c}, node_id) FILTER (embedding IS NOT NULL) AS {c}" for c in ("embedding_provider", "embedding_model", "embedding_schema_version")) + " FROM cur GROUP BY graph_id",
        "rebuild_embeddings": with_cur + f"SELECT graph_id, count(*) FILTER (kind IN {_EMBED}) AS embedded, greatest(0, count(*) FILTER (kind IN {_EMBED} AND embedding IS NOT NULL) - count(*) FILTER (kind IN {_EMBED})) AS skipped FROM cur WHERE graph_id IS NOT NULL GROUP BY graph_id",
        "catalog_with_status": with_cur + ", listed AS (" + _LISTED.format("true", 50) + "), st AS (SELECT graph_id, coalesce(bool_or(embedding IS NOT NULL), false) AS ready, " + ", ".join(f"arg_min_null({c}, node_id) FILTER (embedding IS NOT NULL) AS {c}" for c in ("embedding_provider", "embedding_model", "embedding_schema_version")) + " FROM cur GROUP BY graph_id) SELECT * FROM listed JOIN st USING (graph_id)",
        "details_answers": f"""WITH {_CUR}, {_REQ}, n AS (SELECT CAST(ceil(count(*) / 50) AS BIGINT) AS requests FROM req), asked AS (SELECT node_id, ('0x' || substr(md5(node_id), 1, 8))::BIGINT % requests AS request FROM req, n),
            f AS (SELECT request, a.node_id, c.node_id IS NOT NULL AS there, regexp_replace(concat(kind, ' ', qualified_name, ': ', coalesce(nullif(docstring, ''), nullif(logic_skeleton, ''), nullif(signature, ''), '')), '^\\s+|\\s+$', '', 'g') AS item FROM asked a LEFT JOIN cur c USING (node_id)),
            links AS (SELECT DISTINCT source_node_id, target_node_id, type FROM edges WHERE source_node_id <> '' AND target_node_id <> ''),
            e AS (SELECT a.request, count(*) AS n_edges FROM links l JOIN asked a ON a.node_id = l.source_node_id JOIN asked b ON b.node_id = l.target_node_id AND a.request = b.request GROUP BY a.request)
            SELECT request, count(*) FILTER (there) AS n_nodes, coalesce(any_value(n_edges), 0) AS n_edges, md5(coalesce(string_agg(item, ' | ' ORDER BY node_id) FILTER (there AND item <> ''), '')) AS digest, coalesce(string_agg(node_id, ' ' ORDER BY node_id) FILTER (NOT there), '') AS missing FROM f LEFT JOIN e USING (request) GROUP BY request""",
        "declared_identity": """WITH f AS (SELECT graph_id, source_path AS path, lower(source_path) AS p, source_text AS t FROM source_files WHERE source_text IS NOT NULL AND graph_id IS NOT NULL),
            k AS (SELECT *, CASE WHEN regexp_matches(p, '(^|/)pyproject\\.toml$') THEN 0 WHEN regexp_matches(p, '(^|/)setup\\.cfg$') THEN 1 WHEN regexp_matches(p, '\\.dist-info/metadata$') THEN 2 WHEN regexp_matches(p, '(^|/)__init__\\.py$') THEN 3 END AS kind FROM f),
            d AS (SELECT graph_id, kind, path, nullif(trim(CASE kind WHEN 0 THEN regexp_extract(regexp_extract(t, '(?s)(?:^|\\n)\\[project\\][ \\t]*\\n(.*?)(?:\\n\\[|$)', 1), '(?m)^[ \\t]*name[ \\t]*=[ \\t]*["'']([^"''\\n]*)["'']', 1) WHEN 3 THEN regexp_extract(regexp_replace(path, '/?__init__\\.py$', ''), '[^/]*$') END), '') AS name,
                nullif(trim(CASE kind WHEN 0 THEN regexp_extract(regexp_extract(t, '(?s)(?:^|\\n)\\[project\\][ \\t]*\\n(.*?)(?:\\n\\[|$)', 1), '(?m)^[ \\t]*version[ \\t]*=[ \\t]*["'']([^"''\\n]*)["'']', 1) WHEN 3 THEN regexp_extract(t, '__version__\\s*=\\s*[''"]([^''"]+)[''"]', 1) END), '') AS version FROM k WHERE kind IN (0, 3)),
            r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY kind, length(path), path, name NULLS FIRST, version NULLS FIRST) AS rn FROM d WHERE name IS NOT NULL OR version IS NOT NULL)
            SELECT graph_id, name, version FROM r WHERE rn = 1""",
        "rebuild_counts": with_cur + f"SELECT graph_id, count(*) FILTER (kind IN {_EMBED}) AS embedded, greatest(0, count(*) FILTER (kind IN {_EMBED} AND embedding IS NOT NULL) - count(*) FILTER (kind IN {_EMBED})) AS skipped FROM cur GROUP BY graph_id",
        "candidate_name_filter": "SELECT name, CAST(CASE WHEN lower(name) LIKE 'li%' THEN 0 ELSE 1 END AS INTEGER) AS rank FROM (SELECT DISTINCT name FROM registry) WHERE lower(name) LIKE '%li%' ORDER BY rank, lower(name), name LIMIT 20",
        "health": "SELECT 'ok' AS status, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT graph_id) FROM nodes) AS n_graphs, (SELECT count(*) FROM edges) AS n_edges",
        "node_merge_last_wins": with_cur + "SELECT node_id, kind, summary, line_start FROM cur",
        "edge_merge_distinct": "SELECT DISTINCT source_node_id, upper(trim(type)) AS type, target_node_id FROM edges",
        "edge_endpoint_resolve": f"SELECT DISTINCT source_node_id, upper(trim(type)) AS type, target_node_id FROM edges WHERE upper(trim(type)) IN {_in(text.LINK_TYPES)} AND source_node_id IN (SELECT node_id FROM nodes) AND target_node_id IN (SELECT node_id FROM nodes)",
        "registry_upsert": "SELECT graph_id, unnest(r) FROM (SELECT graph_id, arg_max({'name': name, 'version': version}, registered_at) AS r FROM registry WHERE graph_id IS NOT NULL GROUP BY graph_id)",
        "khop_expand": """WITH both_ways AS (SELECT source_node_id AS a, target_node_id AS b FROM edges WHERE source_node_id <> '' AND target_node_id <> '' UNION SELECT target_node_id, source_node_id FROM edges WHERE source_node_id <> '' AND target_node_id <> ''),
            h0 AS (SELECT DISTINCT node_id, 0 AS distance FROM nodes WHERE kind = 'Library'), h1 AS (SELECT DISTINCT b AS node_id, 1 AS distance FROM h0 JOIN both_ways ON a = node_id), h2 AS (SELECT DISTINCT b AS node_id, 2 AS distance FROM h1 JOIN both_ways ON a = node_id)
            SELECT node_id, CAST(min(distance) AS INTEGER) AS distance FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node_id""",
        "inherits_edges": with_cur + ", b AS (SELECT graph_id, node_id AS source_node_id, regexp_extract(unnest(bases), '[^.]*$') AS name FROM cur WHERE kind = 'Class'), c AS (SELECT *, count(*) OVER (PARTITION BY graph_id, name) AS n_candidates FROM cur WHERE kind = 'Class') SELECT DISTINCT source_node_id, node_id AS target_node_id, n_candidates FROM b JOIN c USING (graph_id, name) WHERE source_node_id <> node_id",
        "library_identity": """WITH f AS (SELECT library_name, source_path, lower(source_path) LIKE '%.toml' AS project, nullif(trim(regexp_extract(source_text, '(?m)^name *= *["'']([^"''\\n]*)["'']', 1)), '') AS name,
            coalesce(nullif(trim(regexp_extract(source_text, '(?m)^version *= *["'']([^"''\\n]*)["'']', 1)), ''), nullif(trim(regexp_extract(source_text, '(?m)^__version__ *= *["'']([^"''\\n]*)["'']', 1)), '')) AS version FROM source_files WHERE source_text IS NOT NULL),
            r AS (SELECT *, row_number() OVER (PARTITION BY library_name ORDER BY NOT project, source_path, name NULLS FIRST, version NULLS FIRST) AS rn FROM f WHERE (project AND name IS NOT NULL) OR version IS NOT NULL)
            SELECT library_name, CASE WHEN project THEN name END AS name, version FROM r WHERE rn = 1""",
        "candidate_cards_json": _top(PLAIN) + " SELECT node_id, CAST(to_json({'node_id': node_id, 'kind': kind, 'qualified_name': qualified_name, 'summary': coalesce(summary, '')}) AS VARCHAR) AS card FROM top",
        "replace_graph": "SELECT graph_id, type, count(*) AS n FROM (SELECT DISTINCT graph_id, source_node_id, target_node_id, upper(trim(type)) AS type FROM edges WHERE graph_id <> '') WHERE graph_id <> 'lumen-core:4.2.0' OR type IN ('CONTAINS', 'DECLARES') GROUP BY ALL",
    }
