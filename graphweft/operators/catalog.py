"""Catalog: graphs with counts and embedding status; maintenance counts; store health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions import text

#: Count columns by kind (fixed values): the catalog's four, the ingest's seven.
FOUR = {"modules": "Module", "classes": "Class", "functions": "Function", "examples": "Example"}
SEVEN = FOUR | {"parameters": "Parameter", "exceptions": "Exception", "returns": "ReturnType"}


def counts_by_kind(nodes: DataFrame, kinds: dict[str, str] = SEVEN) -> DataFrame:
    """Nodes per graph and kind, one column per kind."""
    return nodes.groupBy("graph_id").agg(*[F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()])


def embedding_status(nodes: DataFrame) -> DataFrame:
    """Per graph whether any node has an embedding, and provider, model and schema of the first one by id."""
    has = F.col("embedding").isNotNull()
    first = lambda c: F.min_by(F.col(c), F.when(has, F.col("node_id"))).alias(c)
    return nodes.groupBy("graph_id").agg(F.coalesce(F.max(has), F.lit(False)).alias("ready"), *[first(c) for c in ("embedding_provider", "embedding_model", "embedding_schema_version")])


def embedding_dimensions(nodes: DataFrame) -> DataFrame:
    """Per graph with an embedding: the length of the first one by node id and how many differ from it.

    Null embeddings do not count, nor do rows with a null node id.
    """
    rows = nodes.where("embedding is not null and node_id is not null").select("graph_id", "node_id", F.size("embedding").alias("n"))
    sizes = rows.groupBy("graph_id", "n").agg(F.min("node_id").alias("first"), F.count("*").alias("times"))
    return sizes.groupBy("graph_id").agg(F.min_by("n", "first").cast("long").alias("dimensions"), (F.sum("times") - F.min_by("times", "first")).alias("n_other"))


def list_graphs(nodes: DataFrame, name_prefix: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Graphs by their Library node with counts, newest first. One grouped aggregate joined, no query per graph."""
    libraries = nodes.where("kind = 'Library'")
    if name_prefix:
        libraries = libraries.where(F.lower("name").startswith(name_prefix.lower()))
    if status:
        libraries = libraries.where(F.coalesce("status", F.lit("active")) == status)
    top = libraries.select("graph_id", "name", F.coalesce("version", F.lit("unknown")).alias("version"), F.coalesce("status", F.lit("active")).alias("status"), "updated_at").orderBy(F.desc("updated_at"), "graph_id").limit(limit)
    counts = counts_by_kind(nodes.join(F.broadcast(top.select("graph_id")), "graph_id", "left_semi"), FOUR)  # at most `limit` rows
    return top.join(counts, "graph_id", "left").select("graph_id", "name", "version", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in FOUR])


def catalog(nodes: DataFrame, name_prefix: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """The whole catalog, newest first: ``list_graphs`` with the embedding status and the last change of each graph.

    ``nodes`` are current rows with the columns of both (``embedding`` and those that name its provider).
    """
    top = list_graphs(nodes, name_prefix, status, limit)
    few = F.broadcast(top.select("graph_id"))  # at most `limit` rows
    ready = embedding_status(nodes.join(few, "graph_id", "left_semi"))
    changed = nodes.where("kind = 'Library'").join(few, "graph_id", "left_semi").groupBy("graph_id").agg(F.max("updated_at").alias("updated_at"))
    return top.join(ready, "graph_id").join(changed, "graph_id")


def rebuild_counts(nodes: DataFrame) -> DataFrame:
    """Per graph: nodes that a rebuild embeds, and those skipped (embedded before, no longer eligible)."""
    eligible = F.col("kind").isin(*text.EMBEDDABLE)
    embedded, before = F.count_if(eligible), F.count_if(eligible & F.col("embedding").isNotNull())
    return nodes.groupBy("graph_id").agg(embedded.alias("embedded"), F.greatest(F.lit(0), before - embedded).alias("skipped"))


def name_filter(name: Column, query: str) -> Column:
    """Rank of a library name for a typed text: 0 for a prefix, 1 for a substring, null for none; blank matches all."""
    q = query.strip().lower()
    if not q:
        return F.lit(0)
    return F.when(F.lower(name).startswith(q), 0).when(F.contains(F.lower(name), F.lit(q)), 1)


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: that the store can be read, with its row counts."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.count_distinct("graph_id").alias("n_graphs"))
    return n.select(F.lit("ok").alias("status"), "n_nodes", "n_graphs", edges.agg(F.count("*")).scalar().alias("n_edges"))
