"""Registered queries on hierarchies and orphan references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators import hierarchy, orphans
from graphweft.session import table


def _found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchies(hierarchy.graph_links(table(spark, d, "edges")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("hierarchy", "node_id", "root_id", "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("hierarchy", "node_id", "parent_id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_found(spark, d)).withColumn("distance", F.col("distance").cast("int"))


def p4_subtrees(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.subtree_sizes(_found(spark, d)).withColumn("height", F.col("height").cast("int"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "node_tombstones"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("edge_id", "endpoint", "reason")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.reference_ends(table(spark, d, "edges"), "edge_id", {"source": "source_node_id", "target": "target_node_id"}, "loaded_at")
    return orphans.orphan_report(_orphans(spark, d), refs, "edges")


def queries() -> dict:
    return {q.__name__: q for q in (p4_found, p4_paths, p4_descendants, p4_subtrees, p6_found, p6_report)}


_WALK = """
    WITH RECURSIVE typed AS (
        SELECT upper(trim(type)) AS t, source_node_id AS s, target_node_id AS g FROM edges
        WHERE source_node_id <> '' AND target_node_id <> ''),
    links AS (
        SELECT hierarchy, child, min(parent) AS parent FROM (
            SELECT 'ownership' AS hierarchy, g AS child, s AS parent FROM typed WHERE t IN ('CONTAINS', 'DECLARES', 'HAS_METHOD')
            UNION ALL SELECT 'inheritance', s, g FROM typed WHERE t = 'INHERITS')
        GROUP BY hierarchy, child),
    walk AS (
        SELECT hierarchy, child AS node_id, parent AS tip, [child] AS path FROM links
        UNION ALL
        SELECT w.hierarchy, w.node_id, l.parent, list_append(w.path, w.tip)
        FROM walk w JOIN links l ON l.hierarchy = w.hierarchy AND l.child = w.tip WHERE NOT list_contains(w.path, w.tip)),
    done AS (
        SELECT w.hierarchy, w.node_id, w.tip AS root_id, CAST(len(w.path) AS INTEGER) AS depth, w.path
        FROM walk w LEFT JOIN links l ON l.hierarchy = w.hierarchy AND l.child = w.tip WHERE l.child IS NULL
        UNION ALL
        SELECT hierarchy, node_id, list_min(list_slice(path, list_position(path, tip), len(path))), -1, NULL FROM walk WHERE list_contains(path, tip))"""

_ENDS = """
    WITH ends AS (
        SELECT DISTINCT edge_id, 'source' AS endpoint, source_node_id AS k, loaded_at FROM edges WHERE source_node_id <> ''
        UNION ALL SELECT DISTINCT edge_id, 'target', target_node_id, loaded_at FROM edges WHERE target_node_id <> ''),
    facts AS (
        SELECT n.node_id, min(created_at) AS first_created, max(deleted_at) AS deleted_at FROM nodes n LEFT JOIN node_tombstones t USING (node_id) GROUP BY n.node_id),
    judged AS (
        SELECT edge_id, endpoint, loaded_at, CASE WHEN f.node_id IS NULL THEN 'missing' WHEN first_created > loaded_at THEN 'late'
            WHEN deleted_at <= loaded_at AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.node_id = e.k AND n.created_at > f.deleted_at AND n.created_at <= e.loaded_at) THEN 'deleted' END AS reason
        FROM ends e LEFT JOIN facts f ON f.node_id = e.k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _WALK + " SELECT hierarchy, node_id, root_id, depth FROM done",
        "p4_paths": _WALK + " SELECT d.hierarchy, node_id, parent AS parent_id, root_id, depth, CASE WHEN path IS NULL THEN NULL ELSE array_to_string(list_prepend(root_id, list_reverse(list_slice(path, 2, len(path)))), ' > ') END AS path FROM done d JOIN links l ON l.hierarchy = d.hierarchy AND l.child = d.node_id",
        "p4_descendants": _WALK + " SELECT hierarchy, ancestor_id, node_id, CAST(distance AS INTEGER) AS distance FROM (SELECT hierarchy, node_id, unnest(list_append(list_slice(path, 2, len(path)), root_id)) AS ancestor_id, unnest(range(1, len(path) + 1)) AS distance FROM done WHERE path IS NOT NULL)",
        "p4_subtrees": _WALK + " SELECT hierarchy, ancestor_id AS node_id, count(*) AS n_descendants, CAST(max(distance) AS INTEGER) AS height FROM (SELECT hierarchy, node_id, unnest(list_append(list_slice(path, 2, len(path)), root_id)) AS ancestor_id, unnest(range(1, len(path) + 1)) AS distance FROM done WHERE path IS NOT NULL) GROUP BY ALL",
        "p6_found": _ENDS + " SELECT edge_id, endpoint, reason FROM judged WHERE reason IS NOT NULL",
        "p6_report": _ENDS + ", months AS (SELECT endpoint, strftime(date_trunc('month', loaded_at), '%Y-%m-%d') AS period, reason FROM judged) SELECT 'edges' AS table_name, endpoint, period, reason, n_orphans, n_references FROM (SELECT endpoint, period, reason, count(*) AS n_orphans FROM months WHERE reason IS NOT NULL GROUP BY ALL) JOIN (SELECT endpoint, period, count(*) AS n_references FROM months GROUP BY ALL) USING (endpoint, period)",
    }
