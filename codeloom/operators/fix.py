"""Removal of unused definitions: a plan of byte ranges, free of overlaps, and the rewriting, checked by a new parse."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PLAN = "path string, def_type string, name string, line int, start long, end long, stable_id string"


def _range(source: str, node: ast.stmt) -> tuple[int, int]:
    """Bytes of whole lines of a statement, decorators included."""
    lines = source.encode().splitlines(keepends=True)
    first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
    return sum(map(len, lines[: first - 1])), sum(map(len, lines[: node.end_lineno]))


def ranges(source: str, wanted: list[tuple[str, str, int]]) -> list[tuple[str, str, int, int, int]]:
    """(type, name, line, start, end) of the statements of the wanted (type, name, line); imports only if they bring that one name."""
    out = []
    try:
        nodes = [n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.stmt)]
    except (SyntaxError, ValueError, RecursionError):
        return []
    for kind, name, line in wanted:
        simple = name.rpartition(".")[2]
        for n in nodes:
            defined = isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.name == simple and kind in ("function", "method", "class")
            imported = kind == "import" and isinstance(n, (ast.Import, ast.ImportFrom)) and len(n.names) == 1 and (n.names[0].asname or n.names[0].name.split(".")[0]) == simple
            assigned = kind == "variable" and isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and n.targets[0].id == simple and isinstance(n.value, ast.Constant)
            if n.lineno == line and (defined or imported or assigned):
                out.append((kind, name, line, *_range(source, n)))
                break
    return out


def plan(files: DataFrame, unused: DataFrame, least: int = 90) -> DataFrame:
    """``(path, def_type, name, line, start, end, stable_id)`` of removals of definitions of confidence ``least`` or more; of overlapping ones the outermost. Parameters are never removed."""
    wanted = unused.where((F.col("confidence") >= least) & (F.col("def_type") != "parameter")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("def_type", "full_name", "line"))).alias("wanted"))
    names = [c.split()[0] for c in _PLAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, source, want in zip(*(batch.column(c).to_pylist() for c in ("path", "source", "wanted")), strict=True):
                rows += [(path, k, n, line, a, b, f"{k}:{n}:{a}:{b}") for k, n, line, a, b in ranges(source, [(w["def_type"], w["full_name"], w["line"]) for w in want])]
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    found = files.join(wanted, "path").select("path", "source", "wanted").mapInArrow(run, _PLAN)
    earlier = Window.partitionBy("path").orderBy("start", F.desc("end"), "stable_id").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("covered", F.coalesce(F.max("end").over(earlier), F.lit(0))).where("start >= covered").drop("covered")


def rewritten(source: str, cuts: list[tuple[int, int]]) -> str | None:
    """The source without the byte ranges, ``pass`` in a body that would be empty; None if it no longer parses."""
    raw = source.encode()
    for a, b in sorted(cuts, reverse=True):
        removed = raw[a:b]
        indent = removed[: len(removed) - len(removed.lstrip(b" \t"))]
        shorter = raw[:a] + raw[b:]
        try:
            ast.parse(shorter)
            raw = shorter
        except SyntaxError:
            raw = raw[:a] + indent + b"pass\n" + raw[b:]
    try:
        ast.parse(raw)
    except (SyntaxError, ValueError):
        return None
    return raw.decode()


def applied(files: DataFrame, planned: DataFrame) -> DataFrame:
    """``(path, source)`` of the files of a plan after it; a file that would no longer parse is left out."""
    cuts = planned.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, rewritten(s, [(c["start"], c["end"]) for c in own])) for p, s, own in zip(*(batch.column(c).to_pylist() for c in ("path", "source", "cuts")), strict=True)]
            kept = [r for r in rows if r[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], pa.string()) for k in (0, 1)], ["path", "source"])

    return files.join(cuts, "path").select("path", "source", "cuts").mapInArrow(run, "path string, source string")
