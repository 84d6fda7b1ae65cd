"""Registered queries of the operators for training data, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm import docpairs, mixing, packing, parsecheck, similar, spam, tokens, top_n
from graphweft.operators.merge import current_rows
from graphweft.session import table, written

Query = Callable[[SparkSession, str], DataFrame]


def p1_ranked(spark: SparkSession, d: str) -> DataFrame:
    return top_n.top_n_per_group(table(spark, d, "candidate_matches"), ["graph_id"], "score", "qualified_name", 10)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_ranked(spark, d).select("graph_id", "qualified_name")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "nodes"), "node_id", "updated_at", {"vector": "metadata.embedding", "model": "metadata.embedding_model"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    lists = similar.most_similar(_vectors(spark, d), id_col="node_id", vector_col="vector", space_cols=["model"], k=10, min_similarity=0.97)
    return similar.similar_pairs(lists, 0.97).toDF("node_id_a", "node_id_b")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    lists = similar.most_similar(_vectors(spark, d), id_col="node_id", vector_col="vector", space_cols=["model"], k=10)
    return lists.select(F.col("id").alias("node_id"), "neighbour", F.round("similarity", 6).alias("similarity"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    function = F.col("kind") == "Function"
    only = lambda c: F.when(function, F.col(c))
    nodes = current_rows(table(spark, d, "nodes"), "node_id", "updated_at", {"kind": "kind", **{c: only(c) for c in ("docstring", "qualified_name", "signature", "source_excerpt")}})
    return docpairs.documented_functions(nodes.where("kind = 'Function'"), id_col="node_id", doc_col="docstring", name_col="qualified_name", signature_col="signature", code_col="source_excerpt")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).select(F.col("id").alias("node_id"))


def p3_without_words(spark: SparkSession, d: str) -> DataFrame:
    """Functions that are left out and whose documentation has no letter: what SQL can tell of ``p3_found``."""
    current = current_rows(table(spark, d, "nodes"), "node_id", "updated_at", {"kind": "kind", "docstring": "docstring"})
    silent = current.where("kind = 'Function'").where(F.coalesce(~F.col("docstring").rlike(r"\p{L}"), F.lit(True))).select("node_id")
    return silent.join(p3_found(spark, d), "node_id", "left_anti")


def p3_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = docpairs.source_functions(table(spark, d, "source_files").dropDuplicates(["file_id"]), id_col="file_id", path_col="source_path", text_col="source_text")
    return docpairs.documented_functions(found, id_col="id", doc_col="doc", name_col="name", signature_col="signature", code_col="code").withColumnRenamed("id", "file_id")


_FILE = {"id_col": "file_id", "path_col": "source_path", "text_col": "source_text"}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parsecheck.unparsable(table(spark, d, "source_files"), **_FILE).select(F.col("id").cast("long").alias("file_id"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files")
    return parsecheck.unparsable_rates(files, parsecheck.unparsable(files, **_FILE), repo_col="library_name", **_FILE)


def p5_json(spark: SparkSession, d: str) -> DataFrame:
    """The flagged files that claim to be JSON."""
    found = parsecheck.unparsable(table(spark, d, "source_files"), **_FILE)
    return found.where("language = 'json'").select(F.col("id").cast("long").alias("file_id"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.with_tokens(table(spark, d, "documents"), text_col="text", keep=["doc_id"])
    packed = packing.pack(sizes, table(spark, d, "pack_sizes"), id_col="doc_id", size_col="n_tokens", pack_col="pack_name", capacity_col="capacity_tokens")
    return packed.select(F.col("pack").alias("pack_name"), F.col("id").alias("doc_id"), "piece", "start", F.col("size").alias("n_tokens"), "container")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    packed = p7_containers(spark, d).select(F.col("pack_name").alias("pack"), "container", F.col("n_tokens").alias("size"))
    return packing.fill_report(packed, table(spark, d, "pack_sizes"), pack_col="pack_name", capacity_col="capacity_tokens")


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Per pack: documents, whether each token of each lies in one piece, pieces too large, containers over the capacity, and whether the fill is 98 % or more, but for one container."""
    pieces = written(p7_containers(spark, d))
    sizes = tokens.with_tokens(table(spark, d, "documents"), text_col="text", keep=["doc_id"])
    packs = table(spark, d, "pack_sizes").groupBy("pack_name").agg(F.min("capacity_tokens").alias("capacity"))
    # pieces of a document follow each other without gaps if they begin where those before them end
    ends = pieces.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("packed"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.count("*").alias("n"), F.count_distinct("start").alias("starts"), F.max("n_tokens").alias("largest"))
    whole = (F.col("packed") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("n") == F.col("starts"))
    docs = ends.join(sizes, "doc_id", "full").groupBy("pack_name").agg(F.count("*").alias("n_docs"), F.min(F.coalesce(whole, F.lit(False))).alias("whole"), F.max("largest").alias("largest"))
    used = pieces.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("used")).groupBy("pack_name").agg(F.max("used").alias("fullest"), F.sum("used").alias("used"), F.count("*").alias("boxes"))
    out = docs.join(used, "pack_name").join(packs, "pack_name")
    return out.select("pack_name", "capacity", "n_docs", "whole", (F.col("largest") > F.col("capacity")).alias("too_large"), (F.col("fullest") > F.col("capacity")).alias("overfull"), (F.col("used") >= 0.98 * F.col("capacity") * (F.col("boxes") - 1)).alias("well_filled"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), id_col="doc_id", source_col="source", text_col="text")


def p8_chosen(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Per target: its documents, how many were used more often than they may or more than once in the list, and whether the goal was met to within a document of the source."""
    chosen, shares = _mix(spark, d)
    chosen = written(chosen)
    caps = shares.select("source", "max_repeats", "n_docs", "available_tokens", "goal_tokens", "labelled_tokens")
    used = chosen.groupBy("id").agg(F.count("*").alias("n"), F.max("source").alias("source"), F.max("repeats").alias("repeats"))
    bad = used.join(caps.select("source", "max_repeats"), "source", "left").where((F.col("n") > 1) | (F.col("repeats") > F.coalesce("max_repeats", F.lit(1)))).groupBy("source").agg(F.count("*").alias("n_wrong"))
    sizes = tokens.with_tokens(table(spark, d, "documents").select(mixing.source_key("source").alias("source"), "text"), text_col="text", keep=["source"])
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    # either the goal or all that the cap allows
    met = (F.abs(F.col("labelled_tokens") - F.col("goal_tokens")) <= F.coalesce("largest", F.lit(0))) | (F.col("labelled_tokens") == F.col("available_tokens") * F.col("max_repeats"))
    return caps.join(bad, "source", "left").join(largest, "source", "left").select("source", "max_repeats", "n_docs", F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"), met.alias("met"))


def p9_scored(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"), id_col="doc_id", text_col="text", lang_col="lang").withColumnRenamed("id", "doc_id")


def p9_link_pages(spark: SparkSession, d: str) -> DataFrame:
    """The flagged pages that have no letters outside of links: what SQL can tell of ``p9_found``."""
    pages = table(spark, d, "documents").where(~F.regexp_replace("text", r"https?://[^\s)\]>\"']+", "").rlike(r"\p{L}")).select("doc_id", "text")
    return pages.where(F.col("text").rlike("https?://")).join(p9_found(spark, d), "doc_id", "left_semi").select("doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scored(spark, d).select("doc_id")


def queries() -> dict[str, Query]:
    own = (
        p1_found, p1_ranked, p2_found, p2_neighbours, p3_found, p3_pairs, p3_source_pairs, p3_without_words, p5_found, p5_rates, p5_json, p7_containers, p7_fill, p7_check,
        p8_chosen, p8_shares, p8_check, p9_found, p9_scored, p9_link_pages,
    )
    return {q.__name__: q for q in own}


_BEST = """
    SELECT graph_id, qualified_name, score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, qualified_name DESC) AS rank FROM (
            SELECT graph_id, qualified_name, max(score) AS score FROM candidate_matches
            WHERE score IS NOT NULL AND NOT isnan(score) AND qualified_name IS NOT NULL GROUP BY ALL))
    WHERE rank <= 10"""

_LISTS = """
    WITH current AS (
        SELECT node_id, arg_max({'v': metadata.embedding, 'm': metadata.embedding_model}, updated_at) AS r FROM nodes GROUP BY node_id),
    usable AS (
        SELECT node_id, r.v AS v, r.m AS m FROM current
        WHERE r.v IS NOT NULL AND len(list_filter(r.v, lambda x: x <> 0)) > 0 AND len(list_filter(r.v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
        SELECT a.node_id, b.node_id AS neighbour, a.v = b.v AS same,
            CASE WHEN a.v = b.v THEN 1.0 ELSE round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)), 9) END AS similarity
        FROM usable a JOIN usable b ON a.m IS NOT DISTINCT FROM b.m AND len(a.v) = len(b.v) AND a.node_id <> b.node_id),
    lists AS (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY same DESC, similarity DESC, neighbour) AS rank FROM pairs)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_without_words": "SELECT node_id FROM (SELECT node_id, arg_max({'k': kind, 'd': docstring}, updated_at) AS r FROM nodes WHERE node_id IS NOT NULL GROUP BY node_id) WHERE r.k = 'Function' AND NOT coalesce(regexp_matches(r.d, '\\p{L}'), false)",
        # (DuckDB takes a comma before a closing bracket, JSON does not)
        "p5_json": "SELECT DISTINCT file_id FROM source_files WHERE lower(source_path) LIKE '%.json' AND source_text IS NOT NULL AND (NOT json_valid(source_text) OR regexp_matches(source_text, ',\\s*[}\\]]'))",
        "p7_check": "SELECT pack_name, min(capacity_tokens) AS capacity, (SELECT count(*) FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> '') AS n_docs, true AS whole, false AS too_large, false AS overfull, true AS well_filled FROM pack_sizes GROUP BY pack_name",
        "p8_check": "SELECT t.source, t.max_repeats, coalesce(n, 0) AS n_docs, CAST(0 AS BIGINT) AS n_wrong, true AS met FROM mix_targets t LEFT JOIN (SELECT lower(trim(source)) AS source, count(*) AS n FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> '' GROUP BY ALL) d ON d.source = lower(trim(t.source))",
        "p9_link_pages": "SELECT doc_id FROM documents WHERE regexp_matches(text, 'https?://') AND NOT regexp_matches(regexp_replace(text, 'https?://[^\\s)\\]>\"'']+', '', 'g'), '\\p{L}')",
        "p1_ranked": _BEST,
        "p1_found": f"SELECT graph_id, qualified_name FROM ({_BEST})",
        "p2_found": _LISTS + " SELECT DISTINCT least(node_id, neighbour) AS node_id_a, greatest(node_id, neighbour) AS node_id_b FROM lists WHERE rank <= 10 AND similarity >= 0.97",
        "p2_neighbours": _LISTS + " SELECT node_id, neighbour, round(similarity, 6) AS similarity FROM lists WHERE rank <= 10",
    }
