"""The graph store: Parquet tables partitioned by graph, replaced graph by graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.operators.merge import current_rows
from graphweft.session import discard, removed, written


def replace_graphs(df: DataFrame, path: str, graphs: DataFrame | None = None) -> None:
    """Replace the partitions of exactly those graphs that ``df`` has rows of; others stay as they are.

    With ``graphs`` (column ``graph_id``) those of them that ``df`` has no rows of are emptied.
    Sorted by kind within files, so that kind filters skip row groups. ``df`` needs a ``graph_id`` column. Rows are
    rebalanced by graph: small graphs come as one file each, a hot graph is split over many tasks and files.
    """
    order = [c for c in ("kind", "qualified_name", "type") if c in df.columns]
    rows = df.where(F.col("graph_id").isNotNull()).hint("rebalance", "graph_id")
    rows.sortWithinPartitions("graph_id", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id").parquet(path)
    if graphs is not None:
        # only the graphs that are replaced by nothing, whose folders are deleted one by one
        gone = graphs.select("graph_id").where("graph_id is not null").distinct().join(rows.select("graph_id").distinct(), "graph_id", "left_anti")
        spark = df.sparkSession
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        removed(spark, *[f"{path}/graph_id={escaped(r['graph_id'])}" for r in gone.toLocalIterator()])


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """As ``read_graphs``, but empty where nothing was stored yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def register(entries: DataFrame, path: str) -> None:
    """Upsert registry entries into the table at ``path``: the last registration of each graph."""
    spark = entries.sparkSession
    merged = written(registered(stored(spark, path, entries.schema), entries))
    merged.write.mode("overwrite").parquet(path)
    discard(merged)


def merged_nodes(nodes: DataFrame, key: str = "node_id", order: str = "updated_at") -> DataFrame:
    """One row per node id, the last state; all other columns from that row."""
    return current_rows(nodes, key, order, {c: c for c in nodes.columns if c != key})


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each (source, type, target) once, and only links whose ends both exist as nodes."""
    known = nodes.select("node_id").where("node_id is not null").distinct()
    links = edges.select("graph_id", "source_node_id", "target_node_id", F.upper(F.trim("type")).alias("type")).where(F.col("type").isin(*text.LINK_TYPES)).dropDuplicates(["source_node_id", "type", "target_node_id"])
    one = links.join(known.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi")
    return one.join(known.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi").select("graph_id", "source_node_id", "target_node_id", "type")


def registered(registry: DataFrame, updates: DataFrame, at: str = "registered_at") -> DataFrame:
    """The registry after an upsert: the last registration of each graph."""
    both = registry.unionByName(updates, allowMissingColumns=True)
    return current_rows(both, "graph_id", at, {c: c for c in both.columns if c != "graph_id"})
