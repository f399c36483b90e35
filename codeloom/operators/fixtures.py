"""pytest fixtures: which definition serves each request, and definitions that none does.

A request sees fixtures of its own file (rank 0), of a conftest in a folder above it (1, the deepest wins), those its file imports (2) and those
of plugins (3); then the least full name. Folders above a file are exploded, so the path-prefix condition is an equi-join.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ROW = "path string, kind string, name string, owner string, line int, extra string"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _last(node: ast.AST) -> str:
    node = node.func if isinstance(node, ast.Call) else node
    return node.attr if isinstance(node, ast.Attribute) else getattr(node, "id", "")


def _file(path: str, source: str) -> Iterator[tuple]:
    tree = ast.parse(source)
    for n in ast.walk(tree):
        if isinstance(n, ast.ImportFrom) and n.module:
            for a in n.names:
                yield path, "import", a.asname or a.name, n.module, n.lineno, a.name
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "pytest_plugins" for t in n.targets):
            for x in ast.walk(n.value):
                if isinstance(x, ast.Constant) and isinstance(x.value, str):
                    yield path, "plugin", x.value, "", n.lineno, ""
        if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        mark = next((d for d in n.decorator_list if _last(d) == "fixture"), None)
        if mark is not None:
            words = {k.arg: k.value.value for k in getattr(mark, "keywords", []) if isinstance(k.value, ast.Constant)}
            yield path, "fixture", words.get("name") or n.name, n.name, n.lineno, "autouse" if words.get("autouse") else ""
        if mark is not None or n.name.startswith("test"):
            for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]:
                if a.arg not in ("self", "cls", "request"):
                    yield path, "request", a.arg, n.name, n.lineno, ""
        for d in n.decorator_list:
            if _last(d) == "usefixtures":
                for x in d.args:
                    if isinstance(x, ast.Constant):
                        yield path, "request", x.value, n.name, n.lineno, ""


def fixture_facts(files: DataFrame) -> DataFrame:
    """Definitions, requests, imports and plugin lists of ``(path, source)`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, source in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True):
                try:
                    rows += _file(path, source)
                except (SyntaxError, ValueError, RecursionError):
                    continue
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "line" else pa.string()) for k, c in zip(_NAMES, columns, strict=True)], _NAMES)

    return files.select("path", "source").where("path is not null and source is not null").mapInArrow(run, _ROW)


def _folder(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def _ancestors(path):
    """Folders that hold the path, from the root (empty) down."""
    parts = F.split(_folder(path), "/")
    return F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def _module(path):
    return F.regexp_replace(F.regexp_replace(path, r"(/__init__)?[.]py$", ""), "/", ".")


def resolved(table: DataFrame) -> DataFrame:
    """``(path, owner, name, fixture_path, fixture_line, rank)``: the best definition of each request that has any."""
    defs = table.where("kind = 'fixture'").select("name", F.col("path").alias("fixture_path"), F.col("line").alias("fixture_line"), F.col("owner").alias("function"))
    requests = table.where("kind = 'request'").select("path", "owner", "name").distinct()
    add = lambda df, rank, depth: df.select("path", "owner", "name", "fixture_path", "fixture_line", F.lit(rank).alias("rank"), depth.alias("depth"))
    here = add(requests.join(defs, "name").where(F.col("path") == F.col("fixture_path")), 0, F.lit(0))
    conftest = defs.where(F.col("fixture_path").rlike(r"(^|/)conftest[.]py$")).withColumn("folder", _folder(F.col("fixture_path")))
    above = requests.withColumn("folder", F.explode(_ancestors(F.col("path")))).join(conftest, ["name", "folder"])
    above = add(above.where(F.col("path") != F.col("fixture_path")), 1, F.length("folder"))
    imports = table.where("kind = 'import'").select("path", "name", F.col("owner").alias("module"), F.col("extra").alias("function"))
    named = defs.withColumn("module", _module(F.col("fixture_path"))).drop("name")
    brought = add(requests.join(imports, ["path", "name"]).join(named, ["module", "function"]), 2, F.lit(0))
    plugins = table.where("kind = 'plugin'").select(F.col("name").alias("module")).distinct()
    offered = add(requests.join(defs.withColumn("module", _module(F.col("fixture_path"))).join(plugins, "module", "left_semi"), "name"), 3, F.lit(0))
    best = Window.partitionBy("path", "owner", "name").orderBy("rank", F.desc("depth"), "fixture_path", "fixture_line")
    every = here.unionByName(above).unionByName(brought).unionByName(offered)
    return every.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth", "depth")


def unused_fixtures(table: DataFrame) -> DataFrame:
    """``(path, line, name)`` of fixtures that serve no request and aren't autouse."""
    used = resolved(table).select(F.col("fixture_path").alias("path"), F.col("fixture_line").alias("line")).distinct()
    return table.where("kind = 'fixture' and extra <> 'autouse'").join(used, ["path", "line"], "left_anti").select("path", "line", "name")
