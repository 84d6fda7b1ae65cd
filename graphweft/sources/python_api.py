"""Python source files to the typed graph of their public API.

A Python worker only reads syntax: one row of facts per public module, class, function, parameter, return
annotation, raised exception and docstring example. Everything that follows from the facts (ids, links,
summaries, excerpts, skeletons) is column expressions.
"""

from __future__ import annotations

import ast
import os
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import text

FACTS = (
    "graph_id string, path string, module string, kind string, name string, qualified string, parent string, parent_kind string, first int, last int, "
    "doc string, signature string, steps array<string>, annotation string, position int, parameter_kind string, code string, bases array<string>, raises array<string>, "
    "is_async boolean, is_method boolean, is_classmethod boolean, is_staticmethod boolean, returns_annotation string, warning string"
)
_NAMES = [f.split()[0] for f in FACTS.split(", ")]
#: Parameters of a function, in the order of its definition; they become rows by an expression.
_PARAMETERS = "array<struct<name: string, kind: string, annotation: string, first: int, last: int>>"
#: Names of parameters that a caller does not give (fixed values).
_BOUND = ("self", "cls")
#: Labels of statements in a logic skeleton (fixed values).
STEPS = {ast.Assign: "assign", ast.AnnAssign: "annotate", ast.If: "branch", ast.For: "loop", ast.While: "while", ast.Try: "try", ast.Return: "return", ast.Expr: "expr"}
#: Summaries of what has no documentation: a text and the column that ends it (fixed values).
SUMMARIES = {
    "Module": ("Public module ", "qualified"), "Class": ("Public class ", "name"), "Function": ("Public function ", "name"), "Parameter": ("Public API parameter ", "name"),
    "ReturnType": ("Declared return type ", "annotation"), "Exception": ("Public API may raise ", "name"), "Example": ("Usage example for ", "parent"),
}


def exported_names(tree: ast.Module) -> set[str]:
    """The strings of plain ``__all__ = [...]`` assignments; other ways to fill it do not count."""
    lists = [s.value for s in tree.body if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in s.targets)]
    return {e.value for v in lists if isinstance(v, ast.List | ast.Tuple) for e in v.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}


def docstring_examples(doc: str | None) -> list[str]:
    """Runs of prompt lines: a ``>>>`` line and the prompt lines after it; any other line ends the run."""
    blocks: list[list[str]] = []
    open_ = False
    for line in (doc or "").splitlines():
        s = line.strip()
        if s.startswith(">>>") and not open_:
            blocks.append([])
            open_ = True
        elif not s.startswith((">>>", "...")):
            open_ = False
        if open_:
            blocks[-1].append(s)
    return ["\n".join(b) for b in blocks]


def _unparsed(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


class _Facts:
    """The rows of one file."""

    def __init__(self, graph_id: str, path: str, module: str):
        self.file = {"graph_id": graph_id, "path": path, "module": module}
        self.rows: list[dict] = []

    def add(self, kind: str, name: str, qualified: str, parent: str | None, parent_kind: str, node: ast.AST | None = None, **more) -> None:
        span = {"first": getattr(node, "lineno", None), "last": getattr(node, "end_lineno", None)}
        self.rows.append(self.file | {"kind": kind, "name": name, "qualified": qualified, "parent": parent, "parent_kind": parent_kind} | span | more)

    def function(self, f, parent: str, parent_kind: str) -> None:
        qualified, marks = f"{parent}.{f.name}", {_unparsed(d) for d in f.decorator_list}
        # the last part after a colon: what the ids of a function's own nodes are built on
        doc, inside = ast.get_docstring(f), qualified.rpartition(":")[2]
        thrown = (r.exc.func if isinstance(r.exc, ast.Call) else r.exc for r in ast.walk(f) if isinstance(r, ast.Raise) and r.exc is not None)
        raises = list(dict.fromkeys(map(ast.unparse, thrown)))
        self.add(
            "Function", f.name, qualified, parent, parent_kind, f, doc=doc, signature=f.name + ast.unparse(f.args), steps=self.steps(f.body), raises=raises, returns_annotation=_unparsed(f.returns),
            is_async=isinstance(f, ast.AsyncFunctionDef), is_method=parent_kind == "Class", is_classmethod="classmethod" in marks, is_staticmethod="staticmethod" in marks, parameters=self.parameters(f.args),
        )
        if f.returns is not None:
            self.add("ReturnType", "return", f"{inside}:return", qualified, "Function", f, annotation=_unparsed(f.returns))
        for name in raises:
            self.add("Exception", name, f"{inside}:{name}", qualified, "Function", f)
        for k, code in enumerate(docstring_examples(doc)):
            self.add("Example", f"example_{k}", f"{qualified}:example:{k}", qualified, "Function", code=code)

    @staticmethod
    def parameters(args: ast.arguments) -> list[dict]:
        lists = {"positional": [*args.posonlyargs, *args.args], "keyword_only": args.kwonlyargs}
        return [{"name": p.arg, "kind": kind, "annotation": _unparsed(p.annotation), "first": p.lineno, "last": p.end_lineno} for kind, members in lists.items() for p in members]

    @staticmethod
    def steps(body: list[ast.stmt]) -> list[str]:
        return [STEPS[type(s)] for s in body if type(s) in STEPS]

    def module(self, tree: ast.Module, lines: int) -> None:
        name = self.file["module"]
        exports = exported_names(tree)
        public = lambda n: n in exports if exports else not n.startswith("_")
        self.add("Module", name.rpartition(".")[2], name, None, "Library", doc=ast.get_docstring(tree))
        self.rows[-1] |= {"first": 1, "last": lines or 1}
        functions = ast.FunctionDef | ast.AsyncFunctionDef
        for s in tree.body:  # definitions inside of other statements are not looked at
            if isinstance(s, functions) and public(s.name):
                self.function(s, name, "Module")
            elif isinstance(s, ast.ClassDef) and public(s.name):
                qualified = f"{name}.{s.name}"
                self.add("Class", s.name, qualified, name, "Module", s, doc=ast.get_docstring(s), steps=self.steps(s.body), bases=[ast.unparse(b) for b in s.bases])
                for m in s.body:
                    if isinstance(m, functions) and not m.name.startswith("_"):
                        self.function(m, qualified, "Class")


def file_facts(graph_id: str, path: str, module: str, source: str) -> list[dict]:
    facts = _Facts(graph_id, path, module)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
        facts.module(tree, len(source.splitlines()))
    except (SyntaxError, ValueError) as e:
        return [facts.file | {"warning": f"Skipped {path} due to syntax error: {getattr(e, 'msg', e)}"}]
    return facts.rows


def _public(module):
    return ~F.exists(F.split(module, r"\."), lambda p: p.startswith("_") & (p != "__init__"))


def api_facts(files: DataFrame) -> DataFrame:
    """Facts of files (``graph_id, path, module, source``): public modules only, a warning row per file that fails.

    Null sources, paths or modules give no rows; files sent twice give their facts twice (the store merges them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            rows = [r for file in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in file_facts(*file)]
            schema = schema or _arrow_schema()
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema=schema)

    rows = files.select("graph_id", "path", "module", "source").where("graph_id is not null and path is not null and module is not null and source is not null")
    return _with_parameters(rows.where(_public(F.col("module"))).mapInArrow(run, f"{FACTS}, parameters {_PARAMETERS}"))


def _with_parameters(facts: DataFrame) -> DataFrame:
    """The facts, each function followed by a row per parameter with its place; bound ones keep theirs but no row."""
    itself = F.array(F.lit(None).cast(facts.schema["parameters"].dataType.elementType))
    rows = facts.select("*", F.posexplode(F.concat(itself, F.coalesce("parameters", F.array().cast(facts.schema["parameters"].dataType)))).alias("place", "p"))
    rows = rows.where(F.col("p").isNull() | ~F.col("p.name").isin(*_BOUND))
    own = {
        "kind": F.lit("Parameter"), "name": F.col("p.name"), "qualified": F.concat_ws(":", F.substring_index("qualified", ":", -1), "p.name"), "parent": F.col("qualified"), "parent_kind": F.lit("Function"),
        "first": F.col("p.first"), "last": F.col("p.last"), "annotation": F.col("p.annotation"), "position": F.col("place") - 1, "parameter_kind": F.col("p.kind"),
        **{c: F.col(c) for c in ("graph_id", "path", "module")},
    }
    return rows.select(*[F.when(F.col("p").isNull(), F.col(c)).otherwise(own.get(c, F.lit(None))).alias(c) for c in _NAMES])


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    parameter = pa.struct([("name", pa.string()), ("kind", pa.string()), ("annotation", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
    return pa.schema([*[(f.split()[0], kinds[f.split()[1]]) for f in FACTS.split(", ")], ("parameters", pa.list_(parameter))])


def api_nodes(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Node rows of the facts. With ``files``, functions and classes also get a 12-line source excerpt."""
    rows = facts.where("warning is null")
    fallback = F.coalesce(*[F.when(F.col("kind") == k, F.concat(F.lit(t), F.coalesce(F.col(c), F.lit("")), F.lit("."))) for k, (t, c) in SUMMARIES.items()])
    if files is not None:
        lines = files.select("graph_id", "path", "source").dropDuplicates(["graph_id", "path"])
        rows = rows.join(lines, ["graph_id", "path"], "left")
        excerpt = F.array_join(F.slice(F.split("source", r"\r\n|\r|\n"), F.greatest(F.coalesce("first", F.lit(1)), F.lit(1)), F.greatest(F.least(F.lit(12), F.coalesce(F.col("last") - F.col("first") + 1, F.lit(0))), F.lit(0))), "\n")
    else:
        excerpt = F.lit(None).cast("string")
    in_code = F.col("kind").isin("Class", "Function")
    return rows.select(
        text.node_id(F.col("graph_id"), F.col("kind"), F.col("qualified")).alias("node_id"),
        "graph_id", "kind", "name", F.when(F.col("kind") == "Module", F.col("qualified")).otherwise(F.col("name")).alias("display_name"), F.col("qualified").alias("qualified_name"), F.col("path").alias("source_path"),
        F.col("first").alias("line_start"), F.col("last").alias("line_end"), text.first_line(F.col("doc"), fallback).alias("summary"), F.col("doc").alias("docstring"), "signature",
        F.nullif(F.array_join(F.slice(F.coalesce("steps", F.array().cast("array<string>")), 1, 8), " -> "), F.lit("")).alias("logic_skeleton"),
        F.when(in_code, excerpt).when(F.col("kind") == "Example", F.col("code")).alias("source_excerpt"), F.lit(True).alias("is_public"),
        "bases", "raises", "annotation", "position", "parameter_kind", "code", "is_async", "is_method", "is_classmethod", "is_staticmethod", "returns_annotation",
    )


def library_nodes(graphs: DataFrame) -> DataFrame:
    """One Library node per graph of ``graph_id, library, version, root_path``; its own id is its qualified name."""
    return graphs.select(
        text.node_id(F.col("graph_id"), F.lit("Library"), F.col("graph_id")).alias("node_id"), "graph_id", F.lit("Library").alias("kind"), F.col("library").alias("name"), F.col("graph_id").alias("qualified_name"),
        F.concat(F.lit("Public API graph for "), "library", F.lit(" "), "version", F.lit(".")).alias("summary"), "version", F.lit("building").alias("status"), "root_path", F.lit(True).alias("is_public"),
    ).distinct()


def api_edges(facts: DataFrame) -> DataFrame:
    """``graph_id, source_node_id, target_node_id, type`` of the facts, each link once."""
    kind = F.col("kind")
    types = {"Module": "CONTAINS", "Class": "DECLARES", "Parameter": "HAS_PARAM", "ReturnType": "RETURNS", "Exception": "RAISES", "Example": "USES_EXAMPLE"}
    link = F.coalesce(*[F.when(kind == k, t) for k, t in types.items()], F.when(F.col("parent_kind") == "Class", "HAS_METHOD"), F.lit("DECLARES"))
    graph = F.col("graph_id")
    return facts.where("warning is null").select(
        "graph_id",
        text.node_id(graph, F.col("parent_kind"), F.coalesce("parent", graph)).alias("source_node_id"),
        text.node_id(graph, kind, F.col("qualified")).alias("target_node_id"),
        link.alias("type"),
    ).distinct()


def read_package(spark: SparkSession, root: str, graph_id: str) -> DataFrame:
    """The Python files below a directory that all executors see, as ``graph_id, path, module, source``.

    Spark's file sources pass over names that begin with an underscore (``__init__.py``), so only the paths are
    listed here and the tasks read the files. Bytes that are not UTF-8 become replacement characters.
    """
    top = os.path.abspath(root)
    paths = sorted(os.path.join(d, f) for d, _, files in os.walk(top) for f in files if f.endswith(".py"))
    base = os.path.dirname(top)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    texts.append(f.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["file", "source"])

    listed = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths) // 64 + 1))
    relative = F.substring("file", len(base) + 2, 1_000_000)
    module = F.regexp_replace(F.translate(F.regexp_replace(relative, r"\.py$", ""), "/", "."), r"(^|\.)__init__$", "")
    return listed.mapInArrow(read, "file string, source string").select(F.lit(graph_id).alias("graph_id"), relative.alias("path"), module.alias("module"), "source")
