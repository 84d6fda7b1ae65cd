"""All registered queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphweft.plans import graph_queries, hierarchy_queries

MODULES = (graph_queries, hierarchy_queries)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.search_candidates_hybrid(spark, sf_dir)
