"""Incremental ingest: a stream of source files into the graph store; counts over arriving links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphweft.session import discard, written
from graphweft.sources import ingest as batch_ingest
from graphweft.sources import store

FILES = "graph_id string, path string, module string, source string, fetched_at timestamp"


def ingest_stream(spark: SparkSession, inbox: str, target: str, checkpoint: str, plan: batch_ingest.Ingest | None = None) -> StreamingQuery:
    """Read Parquet files of sources as they arrive; each micro-batch is merged into the files of its graphs.

    The store keeps the last fetch of each path below ``files``; graphs that a batch brings files of are built
    anew from all of their files. Merging is idempotent, so a batch that runs again leaves the same store.
    """
    plan = plan or batch_ingest.Ingest(embedding_mode="disabled")
    stream = spark.readStream.schema(FILES).parquet(inbox)

    def put(batch: DataFrame, _: int) -> None:
        new = written(batch_ingest.current_files(batch))
        graphs = new.select("graph_id").distinct()
        known = store.stored(spark, f"{target}/files", new.schema).join(graphs, "graph_id", "left_semi")
        merged = written(batch_ingest.current_files(known.unionByName(new)))
        store.replace_graphs(merged, f"{target}/files")
        batch_ingest.ingest(merged.drop("fetched_at"), target, plan)
        discard(new, merged)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def link_counts(links: DataFrame, window: str = "1 hour", delay: str | None = None) -> DataFrame:
    """``starts_at, type, n``: links per window of their load time and type; of a table or of a stream.

    The state is as large as windows x types, whatever the number of links; with a ``delay`` a stream lets go of
    windows that ended longer ago, and rows that come later still are left out. Otherwise late rows count in their
    window. Rows with a null time count nowhere, a null type is a type.
    """
    rows = links.select(F.col("loaded_at").cast("timestamp").alias("at"), F.upper(F.trim("type")).alias("type")).where("at is not null")
    rows = rows.withWatermark("at", delay) if delay else rows
    return rows.groupBy(F.window("at", window).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("starts_at"), "type", "n")


def count_arrivals(spark: SparkSession, inbox: str, schema, target: str, checkpoint: str, window: str = "1 hour", names: str = "*", delay: str | None = None) -> StreamingQuery:
    """Read Parquet files of links as they arrive and keep the counts of all windows at ``target`` up to date.

    ``inbox`` is a folder, ``names`` a pattern for the names of its files. Each micro-batch writes the counts that
    it changed as a partition of its own, so a batch that runs again after a failure changes nothing;
    ``arrival_counts`` reads the last count of each window and type.
    """
    counts = link_counts(spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(inbox), window, delay)

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrival_counts(spark: SparkSession, target: str) -> DataFrame:
    """``starts_at, type, n`` as of the last batch."""
    return spark.read.parquet(target).groupBy("starts_at", "type").agg(F.max_by("n", "batch").alias("n"))
