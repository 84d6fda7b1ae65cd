"""Details: nodes by id, the induced subgraph, missing ids, context text; and expansion along links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.params import Details


def shown(nodes: DataFrame, request: Details) -> DataFrame:
    """Nodes as a lookup shows them; columns that its flags leave out are null."""
    keep = lambda c, flag: F.col(c) if flag else F.lit(None).cast("string").alias(c)
    return nodes.select("node_id", "graph_id", "kind", "name", "qualified_name", "signature", keep("docstring", request.docstring), keep("logic_skeleton", request.skeleton), keep("source_excerpt", request.excerpt))


def nodes_by_ids(nodes: DataFrame, request: Details) -> DataFrame:
    """The requested nodes. At most 100 ids, so a pushed-down IN."""
    return shown(nodes.where(F.col("node_id").isin(*request.node_ids)), request)


#: Place and metadata that an answer gives with a node.
PLACE = ("source_path", "line_start", "line_end")


def answers(nodes: DataFrame, edges: DataFrame, requests: DataFrame, flags: Details) -> DataFrame:
    """The answer of each lookup: ``request, nodes, edges, expanded_context, missing_node_ids``.

    ``requests`` has ``request, pos, node_id``, some hundred ids a lookup at most; ``nodes`` are current rows, whose
    place columns and ``metadata`` (if they are there) come along. ``flags`` says what is included; without its
    ``relationships`` there are no edges. Nodes and missing ids keep the order of the request, repeated ids count
    once as nodes; edges are the distinct links between ids of the lookup.
    """
    asked = requests.where("node_id is not null").groupBy("request", "node_id").agg(F.min("pos").alias("pos"))
    held = [c for c in (*PLACE, "metadata") if c in nodes.columns]
    said = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("docstring", "logic_skeleton", "signature")], F.lit(""))
    item = F.concat_ws("", "kind", F.lit(" "), "qualified_name", F.lit(": "), said).alias("item")
    full = nodes.select("node_id", F.struct(*held).alias("more")) if held else nodes.select("node_id", F.lit(None).cast("string").alias("more"))
    found = asked.join(shown(nodes, flags).join(full, "node_id"), "node_id", "left")
    card = F.struct("node_id", "graph_id", "kind", "name", "qualified_name", "signature", "docstring", "logic_skeleton", "source_excerpt", "more")
    there = F.col("graph_id").isNotNull() | F.col("kind").isNotNull()
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["x"])
    rows = found.groupBy("request").agg(
        ordered(F.when(there, F.struct("pos", card.alias("x")))).alias("nodes"),
        text.compress(ordered(F.when(there, F.struct("pos", "node_id", item.alias("x")))), 1_000_000).alias("expanded_context"),
        ordered(F.when(~there, F.struct("pos", F.col("node_id").alias("x")))).alias("missing_node_ids"),
    )
    link = "array<struct<source_node_id:string,target_node_id:string,type:string>>"
    if not flags.relationships:
        return rows.select("request", "nodes", F.array().cast(link).alias("edges"), "expanded_context", "missing_node_ids")
    member = asked.select("request", "node_id")
    links = edges.select("source_node_id", "target_node_id", "type").where("source_node_id <> '' and target_node_id <> ''").distinct()
    one = links.join(member.withColumnRenamed("node_id", "source_node_id"), "source_node_id")
    both = one.join(member.withColumnRenamed("node_id", "target_node_id"), ["request", "target_node_id"], "left_semi")
    within = both.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("source_node_id", "target_node_id", "type"))).alias("edges"))
    return rows.join(within, "request", "left").select("request", "nodes", F.coalesce("edges", F.array().cast(link)).alias("edges"), "expanded_context", "missing_node_ids")


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct links with both ends among ``ids`` (column ``node_id``), of any type, with their direction."""
    known = ids.select("node_id").where("node_id is not null").distinct()
    ends = edges.select("source_node_id", "target_node_id", "type")
    one = ends.join(known.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi")
    return one.join(known.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi").select("source_node_id", "target_node_id", "type").distinct()


def missing_ids(requested: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pos, node_id`` of the requested ids that no node has; order and repeats are kept by ``pos``."""
    return requested.join(nodes.select("node_id").distinct(), "node_id", "left_anti").select("pos", "node_id")


def in_requests(nodes: DataFrame, size: int = 50) -> DataFrame:
    """``nodes`` with ``request``: each graph's nodes cut into lookups of about ``size`` ids, far below twice as many.

    The lookup follows from a digest of the id and the graph's number of nodes, so no graph is sorted or gathered.
    """
    counts = nodes.groupBy("graph_id").agg(F.ceil(F.count("*") / size).alias("__requests"))
    drawn = F.conv(F.substring(F.md5("node_id"), 1, 8), 16, 10).cast("long")
    return nodes.join(counts, "graph_id").withColumn("request", F.pmod(drawn, F.col("__requests"))).drop("__requests")


def context(nodes: DataFrame) -> DataFrame:
    """Per graph and request: what says most about each node, between bars, in the order of the node ids.

    A row holds one lookup (``in_requests``), never a whole graph.
    """
    said = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("docstring", "logic_skeleton", "signature")], F.lit(""))
    item = F.concat_ws("", "kind", F.lit(" "), "qualified_name", F.lit(": "), said)
    items = F.transform(F.array_sort(F.collect_list(F.struct("node_id", item.alias("item")))), lambda x: x["item"])
    return nodes.groupBy("graph_id", "request").agg(text.compress(items, 1_000_000).alias("context"))


def expand(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """``node_id, distance`` of all nodes within ``hops`` links (either direction) of the start nodes.

    Each hop is one equi-join of the frontier alone; nodes that were reached before do not spread again.
    """
    ends = edges.where("source_node_id <> '' and target_node_id <> ''").select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b"))
    both = ends.union(ends.select("b", "a")).distinct()
    seen = start.select("node_id", F.lit(0).alias("distance")).distinct()
    frontier = seen
    for hop in range(1, hops + 1):
        new = frontier.join(both, frontier["node_id"] == both["a"]).select(F.col("b").alias("node_id")).distinct().join(seen.select("node_id"), "node_id", "left_anti")
        frontier = new.withColumn("distance", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def inherits(nodes: DataFrame) -> DataFrame:
    """``source_node_id, target_node_id, n_candidates``: links from the classes to their bases in the same graph.

    A base is told by its last name; ``n_candidates`` says how many classes of the graph have it, so that ambiguous
    links can be told from sure ones.
    """
    classes = nodes.where("kind = 'Class'")
    bases = classes.select("graph_id", F.col("node_id").alias("source_node_id"), F.explode("bases").alias("base")).withColumn("name", text.last_part(F.col("base")))
    named = classes.select("graph_id", "name", F.col("node_id").alias("target_node_id"))
    named = named.join(named.groupBy("graph_id", "name").agg(F.count("*").alias("n_candidates")), ["graph_id", "name"])
    return bases.join(named, ["graph_id", "name"]).where("source_node_id <> target_node_id").select("source_node_id", "target_node_id", "n_candidates").distinct()
