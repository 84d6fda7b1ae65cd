import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphweft.operators import catalog, details
from graphweft.params import Details
from graphweft.sources import embedding, python_api, store
from graphweft.sources import ingest as library_ingest
from graphweft.streaming import ingest

API = '''class Client:
    """A client."""

    def run(self, value: int) -> str:
        """Run the operation.

        >>> c = Client()
        >>> c.run(3)
        'x'
        """
        if value < 0:
            raise ValueError("no")
        return str(value)

    def _hidden(self):
        pass


def helper(name: str, *rest, flag=False, **more) -> str:
    """Build a greeting."""
    return name


async def fetch():
    raise
    raise error
'''
FILES = [("g:1", "pkg/api.py", "pkg.api", API), ("g:1", "pkg/_no.py", "pkg._no", API), ("g:1", "pkg/bad.py", "pkg.bad", "def ("), ("g:1", "pkg/e.py", "pkg.e", ""), ("g:1", "pkg/x.py", "pkg.x", None), ("g:1", "pkg/z.py", "pkg.z", '__all__ = ["_a"]\ndef _a(): pass\ndef b(): pass\nif 1:\n    def c(): pass\n')]
SCHEMA = "graph_id string, path string, module string, source string"


def test_facts_nodes_edges(spark):
    files = spark.createDataFrame(FILES, SCHEMA)
    facts = python_api.api_facts(files)
    nodes = {r.node_id: r for r in python_api.api_nodes(facts, files).collect()}
    run = nodes["g:1:Function:pkg.api.Client.run"]
    assert (run.signature, run.logic_skeleton, run.raises, run.summary, run.line_start, run.returns_annotation) == ("runself, value: int", "expr -> branch -> return", ["ValueError"], "Run the operation.", 4, "str")
    assert run.source_excerpt.startswith("    def run(self") and len(run.source_excerpt.split("\n")) == 10
    assert nodes["g:1:Parameter:pkg.api.Client.run:value"].position == 1
    assert nodes["g:1:Parameter:pkg.api.helper:flag"].parameter_kind == "keyword_only"
    assert nodes["g:1:Example:pkg.api.Client.run:example:0"].code == ">>> c = Client()\n>>> c.run(3)"
    assert nodes["g:1:Class:pkg.api.Client"].summary == "A client." and nodes["g:1:Module:pkg.e"].line_end == 1
    assert {k.split(":", 2)[2] for k in nodes if ":Function:" in k} == {f"Function:pkg.{x}" for x in ("api.Client.run", "api.helper", "api.fetch", "z._a")}
    assert nodes["g:1:Function:pkg.api.fetch"].is_async and nodes["g:1:Function:pkg.api.fetch"].raises == ["error"]
    edges = [tuple(r) for r in python_api.api_edges(facts).collect()]
    assert ("g:1", "g:1:Class:pkg.api.Client", "g:1:Function:pkg.api.Client.run", "HAS_METHOD") in edges
    assert ("g:1", "g:1:Library:g:1", "g:1:Module:pkg.api", "CONTAINS") in edges and len(edges) == len(nodes)
    assert [r.path for r in facts.where("warning is not null").collect()] == ["pkg/bad.py"]


def test_read_package(spark, tmp_path):
    (tmp_path / "pkg" / "sub").mkdir(parents=True)
    for name, body in (("__init__.py", "x = 1\n"), ("sub/__init__.py", ""), ("sub/a.py", "def f(): pass\n")):
        (tmp_path / "pkg" / name).write_text(body)
    rows = {(r.path, r.module) for r in python_api.read_package(spark, str(tmp_path / "pkg"), "g:1").collect()}
    assert {m for _, m in rows} == {"pkg", "pkg.sub", "pkg.sub.a"}


def test_store_replaces_only_its_graph(spark, tmp_path):
    path = str(tmp_path / "edges")
    rows = lambda *r: spark.createDataFrame(r, "graph_id string, type string")
    store.replace_graphs(rows(("a", "x"), ("a", "y"), ("b", "x")), path)
    store.replace_graphs(rows(("a", "z")), path)
    assert sorted((r.graph_id, r.type) for r in store.read_graphs(spark, path).collect()) == [("a", "z"), ("b", "x")]


def test_merge_and_resolve(spark):
    t = lambda n: datetime(2024, 1, n)
    nodes = spark.createDataFrame([("a", "old", t(1)), ("a", "new", t(2)), ("b", "x", None), (None, "y", t(1))], "node_id string, name string, updated_at timestamp")
    assert {(r.node_id, r.name) for r in store.merged_nodes(nodes).collect()} == {("a", "new"), ("b", "x")}
    edges = spark.createDataFrame([("g", "a", "b", " calls"), ("g", "a", "b", "CALLS"), ("g", "a", "c", "CALLS"), ("g", "a", "b", "odd")], "graph_id string, source_node_id string, target_node_id string, type string")
    assert [tuple(r) for r in store.resolved_edges(edges, nodes).collect()] == [("g", "a", "b", "CALLS")]


def test_details(spark):
    nodes = spark.createDataFrame([("a", "g", "Class", "A", "m.A", None, "doc", None, "src"), ("b", "g", "Class", "B", "m.B", "sig", "", "x -> y", None)], "node_id string, graph_id string, kind string, name string, qualified_name string, signature string, docstring string, logic_skeleton string, source_excerpt string")
    got = {r.node_id: r for r in details.nodes_by_ids(nodes, Details(("a", "zz"), excerpt=True, docstring=False)).collect()}
    assert set(got) == {"a"} and got["a"].docstring is None and got["a"].source_excerpt == "src"
    assert details.context(details.in_requests(nodes)).first().context == "Class m.A: doc | Class m.B: x -> y"
    asked = spark.createDataFrame([(0, "zz"), (1, "a"), (2, "zz")], "pos int, node_id string")
    assert sorted(tuple(r) for r in details.missing_ids(asked, nodes).collect()) == [(0, "zz"), (2, "zz")]
    links = spark.createDataFrame([("a", "b", "X"), ("a", "b", "X"), ("a", "zz", "X"), ("a", "", "X")], "source_node_id string, target_node_id string, type string")
    lookups = spark.createDataFrame([(1, 0, "b"), (1, 1, "zz"), (1, 2, "a"), (1, 3, "b"), (2, 0, "b"), (2, 1, None)], "request int, pos int, node_id string")
    one, two = details.answers(nodes, links, lookups, Details(("x",), excerpt=True)).orderBy("request").collect()
    assert [n.node_id for n in one.nodes] == ["b", "a"] and one.missing_node_ids == ["zz"] and [tuple(e) for e in one.edges] == [("a", "b", "X"), ("a", "zz", "X")]
    assert one.expanded_context == "Class m.B: x -> y | Class m.A: doc" and one.nodes[1].source_excerpt == "src"
    assert [n.node_id for n in two.nodes] == ["b"] and two.edges == [] and two.missing_node_ids == []
    assert details.answers(nodes, links, lookups, Details(("x",), relationships=False)).orderBy("request").first().edges == []
    edges = spark.createDataFrame([("a", "b", "X"), ("a", "b", "X"), ("b", "c", "X"), ("c", "d", "X"), ("a", None, "X")], "source_node_id string, target_node_id string, type string")
    assert [tuple(r) for r in details.induced_edges(edges, nodes).collect()] == [("a", "b", "X")]
    assert sorted(tuple(r) for r in details.expand(edges, asked.where("pos = 1").select("node_id"), 2).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_requests_stay_small(spark):
    many = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("node_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("g"), F.col("id") % 90)).otherwise("hot").alias("graph_id"))
    sizes = [r["count"] for r in details.in_requests(many).groupBy("graph_id", "request").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 100


def test_hot_graph_is_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        store.replace_graphs(spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("type"), F.lit("hot").alias("graph_id")), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    rows = store.read_graphs(spark, path)
    assert rows.count() == 20000 and rows.select(F.input_file_name()).distinct().count() > 1


def test_catalog_of_nothing(spark):
    empty = spark.createDataFrame([], "node_id string, graph_id string, kind string, name string, version string, status string, updated_at timestamp, embedding array<double>")
    assert catalog.list_graphs(empty).collect() == [] and catalog.embedding_dimensions(empty).collect() == [] and catalog.rebuild_counts(empty).collect() == []
    names = spark.createDataFrame([("Numpy",), ("annotated",), ("annumba",), (None,)], "n string").select("n", catalog.name_filter(F.col("n"), " nu ").alias("r"))
    assert {(r.n, r.r) for r in names.collect() if r.r is not None} == {("Numpy", 0), ("annumba", 1)}


def test_providers(spark):
    sent = []

    def post(url, body, headers, timeout):
        sent.append((url, json.dumps(body)))
        return {"data": [{"embedding": [1, 2]}], "embeddings": [[3, 4]], "embedding": {"values": [5, 6]}}

    for kind, want in (("local", [3.0, 4.0]), ("data", [1.0, 2.0]), ("content", [5.0, 6.0])):
        p = embedding.provider(kind, url="http://h/", model="m", key="k")
        p.post = post
        assert p.embed(["t"]) == [want]
    assert sent[0][0] == "http://h/api/embed"
    with pytest.raises(ValueError):
        embedding.provider("data", url="x")
    with pytest.raises(ValueError):
        embedding.provider("other")
    nodes = spark.createDataFrame([("a", "Class", "q", "s", None, "d"), ("p", "Parameter", "q", "s", None, "d")], "node_id string, kind string, qualified_name string, summary string, signature string, docstring string")

    class Lengths:
        name = model = schema_version = "x"

        def embed(self, texts):
            return [[float(len(t))] for t in texts]

    assert [tuple(r) for r in embedding.embed_with(nodes, Lengths()).collect()] == [("a", [17.0], "Class | q | s | d")]


def test_stream(spark, tmp_path):
    inbox, target = str(tmp_path / "in"), str(tmp_path / "store")
    row = lambda g, src, n: (g, "m.py", "m", src, datetime(2024, 1, n))
    put = lambda *rows: spark.createDataFrame(rows, ingest.FILES).write.mode("append").parquet(inbox)
    put(row("a", "def f(): pass\n", 1), row("a", "def g(): pass\n", 2), row("b", "x = 1\n", 1))
    ingest.ingest_stream(spark, inbox, target, str(tmp_path / "cp")).awaitTermination()
    put(row("b", "class K: pass\n", 3))
    ingest.ingest_stream(spark, inbox, target, str(tmp_path / "cp")).awaitTermination()
    got = {(r.graph_id, r.kind, r.name) for r in store.read_graphs(spark, f"{target}/nodes").collect()}
    assert got == {("a", "Library", "a"), ("a", "Module", "m"), ("a", "Function", "g"), ("b", "Library", "b"), ("b", "Module", "m"), ("b", "Class", "K")}
    # a graph over several batches keeps the files of the earlier ones
    spark.createDataFrame([("a", "n.py", "n", "class N: pass\n", datetime(2024, 1, 4)), ("b", "m.py", "m", "late = 1\n", datetime(2024, 1, 2))], ingest.FILES).write.mode("append").parquet(inbox)
    ingest.ingest_stream(spark, inbox, target, str(tmp_path / "cp")).awaitTermination()
    got = {(r.graph_id, r.kind, r.name) for r in store.read_graphs(spark, f"{target}/nodes").where("kind <> 'Library'").collect()}
    assert got == {("a", "Module", "m"), ("a", "Function", "g"), ("a", "Module", "n"), ("a", "Class", "N"), ("b", "Module", "m"), ("b", "Class", "K")}


def test_ingest_end_to_end(spark, tmp_path):
    files = spark.createDataFrame([(*f, "My Lib", "1") for f in FILES], SCHEMA + ", library string, version string")
    target = str(tmp_path / "t")
    one = library_ingest.ingest(files, target, library_ingest.Ingest()).collect()
    assert [(r.graph_id, r.library, r.version, r.modules, r.classes, r.functions, r.examples, r.embedded_nodes, r.model) for r in one] == [("g:1", "My Lib", "1", 3, 1, 4, 1, 9, "deterministic-hash")]
    assert one[0].warnings[0].startswith("Skipped pkg/bad.py") and one[0].stages.endswith("embed,persist,registry_update")
    nodes = store.read_graphs(spark, f"{target}/nodes")
    library = nodes.where("kind = 'Library'").first()
    assert (library.node_id, library.summary, library.status, library.embedding) == ("g:1:Library:g:1", "Public API graph for My Lib 1.", "building", None)
    assert store.resolved_edges(store.read_graphs(spark, f"{target}/edges"), nodes).count() == nodes.count() - 1
    assert [(r.graph_id, r.name, r.status, r.counts.functions) for r in spark.read.parquet(f"{target}/registry").collect()] == [("g:1", "My Lib", "active", 4)]
    assert [tuple(r) for r in library_ingest.rebuild_embeddings(spark, target, library_ingest.Ingest()).collect()] == [("g:1", 9, 0)]
    assert store.read_graphs(spark, f"{target}/nodes").where("embedding is not null").count() == 9
    # replaced by nothing: the Library node is all that is left, and no link
    empty = spark.createDataFrame([("g:1", "pkg/e.py", None, "")], SCHEMA)
    again = library_ingest.ingest(empty, target, library_ingest.Ingest("parse_load")).first()
    assert (again.library, again.version, again.modules, again.embedded_nodes, again.provider) == ("g", "1", 0, 0, None)
    assert [r.kind for r in store.stored(spark, f"{target}/nodes", nodes.schema).collect()] == ["Library"]
    assert store.stored(spark, f"{target}/edges", "source_node_id string, graph_id string").collect() == []
    only = library_ingest.ingest(files, str(tmp_path / "no"), library_ingest.Ingest("parse_only")).first()
    assert only.functions == 4 and "persist" not in only.stages and not (tmp_path / "no" / "nodes").exists()
    with pytest.raises(ValueError):
        library_ingest.Ingest("other")


def test_declared_identity(spark):
    rows = [
        ("a", "pyproject.toml", '[tool.x]\nname = "no"\n[project]\nname = "lib-a"\nversion = "1.2"\n[other]\nversion = "9"\n'), ("a", "a/__init__.py", "__version__ = '3'\n"),
        ("b", "setup.cfg", "[options]\nname = no\n[metadata]\nname = lib_b\nversion = 2.0\n"), ("c", "site/c-1.dist-info/METADATA", "Metadata-Version: 2.1\nName: lib.c\nVersion: 0.1\n"),
        ("d", "d/sub/__init__.py", "__version__ = '8'"), ("d", "d/__init__.py", "__version__ = '0.9.1'\n"), ("e", "x.py", "__version__ = '1'"), ("f", "pyproject.toml", None), (None, "setup.cfg", "[metadata]\nname = x\n"),
    ]
    df = spark.createDataFrame(rows, "graph_id string, path string, source string")
    assert {tuple(r) for r in library_ingest.library_identity(df).collect()} == {("a", "lib-a", "1.2"), ("b", "lib_b", "2.0"), ("c", "lib.c", "0.1"), ("d", "d", "0.9.1")}


def test_stream_counts(spark, tmp_path):
    inbox, target, schema = str(tmp_path / "in"), str(tmp_path / "out"), "type string, loaded_at timestamp"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    run = lambda: ingest.count_arrivals(spark, inbox, spark.read.parquet(inbox).schema, target, str(tmp_path / "cp"), "1 day").awaitTermination()
    put((" calls", datetime(2024, 1, 1, 3)), ("CALLS", datetime(2024, 1, 1, 4)), (None, datetime(2024, 1, 1)), ("CALLS", None))
    run()
    put(("calls", datetime(2023, 5, 1)), ("calls", datetime(2024, 1, 1, 23)))  # late rows
    run()
    got = {(r.starts_at.day, r.starts_at.year, r.type, r.n) for r in ingest.arrival_counts(spark, target).collect()}
    assert got == {(1, 2024, "CALLS", 3), (1, 2024, None, 1), (1, 2023, "CALLS", 1)}
