"""Ingest of libraries end to end: parse, add the Library node, embed, persist, register; and rebuilding embeddings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.operators import catalog
from graphweft.operators.merge import current_rows
from graphweft.params import InvalidInput
from graphweft.session import discard, written
from graphweft.sources import embedding, python_api, store

#: How far an ingest goes, and whether it embeds (fixed values).
MODES, EMBEDDING_MODES = ("parse_only", "parse_load", "parse_load_embed"), ("enabled", "disabled")
#: Columns of a library that a file row may carry; without them they follow from the graph id.
LIBRARY = ("library", "version", "root_path")
#: What an embedding adds to a node.
EMBEDDED = ("embedding", "embedding_text", "embedding_provider", "embedding_model", "embedding_dimensions", "embedding_schema_version")


@dataclass(frozen=True)
class Ingest:
    """What an ingest does; ``provider`` None embeds by hashes."""

    mode: str = "parse_load_embed"
    embedding_mode: str = "enabled"
    provider: embedding.Provider | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise InvalidInput(f"unknown ingest mode {self.mode}")
        if self.embedding_mode not in EMBEDDING_MODES:
            raise InvalidInput(f"unknown embedding mode {self.embedding_mode}")

    @property
    def embeds(self) -> bool:
        return self.mode == "parse_load_embed" and self.embedding_mode != "disabled"

    @property
    def model(self) -> tuple[str, str, str]:
        p = self.provider
        return (p.name, p.model, p.schema_version) if p else embedding.HASH_EMBEDDING


def libraries(files: DataFrame) -> DataFrame:
    """``graph_id, library, version, root_path`` of the graphs that files belong to, one row each."""
    given = {c: F.max(c) if c in files.columns else F.lit(None).cast("string") for c in LIBRARY}
    rows = files.where("graph_id is not null").groupBy("graph_id").agg(F.lit(1).alias("one"), *[c.alias(n) for n, c in given.items()])
    before = F.regexp_extract("graph_id", "^(.*?)(?::([^:]*))?$", 1)
    after = F.nullif(F.regexp_extract("graph_id", "^(.*?)(?::([^:]*))?$", 2), F.lit(""))
    return rows.select("graph_id", F.coalesce("library", before).alias("library"), F.coalesce("version", after, F.lit("unknown")).alias("version"), "root_path")


def graph_nodes(facts: DataFrame, files: DataFrame) -> DataFrame:
    """The Library node and all other nodes of the files' graphs; of a node that comes twice one row."""
    nodes = python_api.api_nodes(facts, files.select("graph_id", "path", "source")).dropDuplicates(["node_id"])
    return nodes.unionByName(python_api.library_nodes(libraries(files)), allowMissingColumns=True)


def embedded(nodes: DataFrame, plan: Ingest) -> DataFrame:
    """The nodes with their embedding columns by the plan's provider; null where a node carries none."""
    nodes = nodes.drop(*EMBEDDED)
    if plan.provider is None:
        return embedding.embed_nodes_hashed(nodes)
    name, model, schema = plan.model
    found = embedding.embed_with(nodes, plan.provider).withColumns({"embedding_provider": F.lit(name), "embedding_model": F.lit(model), "embedding_dimensions": F.size("embedding"), "embedding_schema_version": F.lit(schema)})
    return nodes.join(found, "node_id", "left")


def ingest(files: DataFrame, target: str, plan: Ingest, at: str | None = None) -> DataFrame:
    """Ingest the graphs of ``files`` (``graph_id, path, module, source`` and, if known, ``library, version,
    root_path``) into the store at ``target``; one row per graph: ``graph_id, library, version``, the seven counts,
    ``embedded_nodes, provider, model, stages, warnings``.

    The graphs are replaced as a whole in ``nodes`` and ``edges`` below ``target``, also where nothing is left of
    one; ``registry`` gets its last registration. ``parse_only`` persists no graph. Files with a null graph, path,
    module or source give nothing but their Library node; files that do not parse give a warning. ``at`` is the time
    of the registration, now if it is not given.
    """
    spark = files.sparkSession
    facts = written(python_api.api_facts(files))
    nodes = graph_nodes(facts, files)
    stages = ["source_discovery", "parse", "filter_to_public_api", "enrich", "map_to_graph"]
    if plan.embeds:
        nodes = embedded(nodes, plan)
        stages.append("embed")
    nodes = written(nodes)
    graphs = libraries(files)
    if plan.mode != "parse_only":
        store.replace_graphs(nodes, f"{target}/nodes", graphs)
        store.replace_graphs(python_api.api_edges(facts), f"{target}/edges", graphs)
        stages.append("persist")
    counts = catalog.counts_by_kind(nodes)
    now = F.to_timestamp(F.lit(at)) if at else F.current_timestamp()
    entry = graphs.join(counts, "graph_id").select("graph_id", F.col("library").alias("name"), "version", F.lit("active").alias("status"), F.struct(*catalog.SEVEN).alias("counts"), now.alias("registered_at"), text.utc_iso(now).alias("registered_at_text"))
    store.register(entry, f"{target}/registry")
    stages.append("registry_update")
    warned = facts.where("warning is not null").groupBy("graph_id").agg(F.array_sort(F.collect_set("warning")).alias("warnings"))
    if plan.embeds:
        done = nodes.where("embedding is not null").groupBy("graph_id").agg(F.count("*").alias("embedded_nodes"))
        provider, model = plan.model[:2]
    else:
        done, (provider, model) = nodes.select("graph_id", F.lit(0).cast("long").alias("embedded_nodes")).distinct(), (None, None)
    out = graphs.join(counts, "graph_id").join(done, "graph_id", "left").join(warned, "graph_id", "left")
    out = written(
        out.select(
            "graph_id", "library", "version", *catalog.SEVEN, F.coalesce("embedded_nodes", F.lit(0)).alias("embedded_nodes"), F.lit(provider).cast("string").alias("provider"), F.lit(model).cast("string").alias("model"),
            F.lit(",".join(stages)).alias("stages"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        )
    )
    discard(facts, nodes)
    return spark.read.schema(out.schema).parquet(*out.inputFiles()) if out.inputFiles() else out


def rebuild_embeddings(spark: SparkSession, target: str, plan: Ingest, graph_ids: tuple[str, ...] = ()) -> DataFrame:
    """Embed the stored nodes of graphs (all, if none is given) anew and write them: ``graph_id, embedded, skipped``.

    ``skipped`` counts nodes that had an embedding before and are no longer of a kind that carries one. Texts keep
    their empty parts, as the index profile composes them.
    """
    nodes = store.read_graphs(spark, f"{target}/nodes")
    nodes = nodes.where(F.col("graph_id").isin(*graph_ids)) if graph_ids else nodes
    before = written(nodes)
    counts = written(catalog.rebuild_counts(before.withColumn("embedding", F.col("embedding") if "embedding" in before.columns else F.lit(None).cast("array<double>"))))
    again = embedding.embed_nodes_hashed(before.drop(*EMBEDDED), keep_empty=True) if plan.provider is None else embedded(before, plan)
    store.replace_graphs(again, f"{target}/nodes")
    discard(before)
    return counts


def library_identity(files: DataFrame) -> DataFrame:
    """``graph_id, name, version`` that the files of each graph declare (``graph_id, path, source``).

    Project files come first (``[project]`` of pyproject.toml), then ``[metadata]`` of setup.cfg, then METADATA of a
    dist-info folder, then ``__version__`` of a package's ``__init__.py``, whose folder is the name; the first of
    these that declares a name or a version counts for both. Paths decide among files of one kind.
    """
    path, source = F.lower("path"), F.col("source")
    section = lambda name: F.regexp_extract(source, rf"(?s)(?:\A|\n)\[{name}\][ \t]*\n(.*?)(?:\n\[|\z)", 1)
    quoted = lambda where, key: F.regexp_extract(where, rf"""(?m)^[ \t]*{key}[ \t]*=[ \t]*["']([^"'\n]*)["']""", 1)
    plain = lambda where, key, sign: F.regexp_extract(where, rf"(?mi)^{key}[ \t]*{sign}[ \t]*(.*)$", 1)
    folder = F.substring_index(F.regexp_replace("path", r"/?__init__\.py$", ""), "/", -1)
    kinds = [
        (path.rlike(r"(^|/)pyproject\.toml$"), 0, quoted(section("project"), "name"), quoted(section("project"), "version")),
        (path.rlike(r"(^|/)setup\.cfg$"), 1, plain(section("metadata"), "name", "="), plain(section("metadata"), "version", "=")),
        (path.rlike(r"\.dist-info/metadata$"), 2, plain(source, "name", ":"), plain(source, "version", ":")),
        (path.rlike(r"(^|/)__init__\.py$"), 3, folder, F.regexp_extract(source, r"""__version__\s*=\s*['"]([^'"]+)['"]""", 1)),
    ]
    pick = lambda k: F.coalesce(*[F.when(is_it, x[k]) for is_it, *x in kinds])
    rows = files.where("source is not null and graph_id is not null").select("graph_id", F.coalesce(*[F.when(is_it, F.lit(n)) for is_it, n, *_ in kinds]).alias("kind"), "path", text.strip_or_null(pick(1)).alias("name"), text.strip_or_null(pick(2)).alias("version"))
    rows = rows.where("kind is not null and (name is not null or version is not null)")
    return rows.groupBy("graph_id").agg(F.min(F.struct("kind", F.length("path").alias("n"), "path", "name", "version")).alias("f")).select("graph_id", "f.name", "f.version")


def current_files(files: DataFrame) -> DataFrame:
    """The last fetch of each path of a graph: ``graph_id, path, module, source, fetched_at``."""
    keyed = files.where("graph_id is not null and path is not null").withColumn("__key", F.struct("graph_id", "path"))
    return current_rows(keyed, "__key", "fetched_at", {c: c for c in ("module", "source", "fetched_at")}).select("__key.graph_id", "__key.path", "module", "source", "fetched_at")
