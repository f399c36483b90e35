"""Python sources as DataFrames ``(path, source)``: directory trees, notebooks and snippets."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import glob_pattern

EXCLUDED = (
    "__pycache__", ".git", ".hg", ".svn", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", ".venv", "venv", "env", ".env", "node_modules", "build", "dist", "site-packages", ".eggs", ".idea", ".vscode", "htmlcov", ".coverage", "*.egg-info", ".pytype", ".npm", "bower_components", "target", "vendor", ".bundle", ".gradle", "gradle", ".mvn", ".vs", ".cache", ".tmp", "tmp", "logs",
)


#: Sources that a task parses.
PARSED = 5_000


def spread(rows: DataFrame, key: str, most: int = PARSED) -> DataFrame:
    """The rows in parts of about ``most`` by the hash of ``key``, and in as many as there are cores if that is more and none falls below a hundred.

    A parse takes a thousand times longer than the read of the row that the source is made of, so the parts that a reader makes by
    bytes are too few: a table of a million short rows is read as one task. Counted first, which reads no column.
    """
    count = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(-(-count // most), min(cores, -(-count // 100)), 1), key)


def ignore_pattern(lines: list[str], base: str = "") -> list[tuple[bool, str]]:
    """(kept again, regular expression) of each line of a .gitignore in folder ``base``, in order; the last that matches a path decides."""
    out = []
    for line in lines:
        line = line.rstrip("\n").rstrip()
        if not line or line.startswith("#"):
            continue
        again = line.startswith("!")
        glob = line.removeprefix("!").removeprefix("\\")
        fixed = "/" in glob.rstrip("/")
        pattern = glob_pattern(glob.strip("/") if not fixed else glob.strip("/") + "").removesuffix("$").removeprefix("^").removeprefix("(?:^|/)")
        prefix = f"^{re.escape(base + '/') if base else ''}" + ("" if fixed else "(?:.*/)?")
        out.append((again, prefix + pattern + ("/.*$" if glob.endswith("/") else "(?:/.*)?$")))
    return out


def not_ignored(path: Column, patterns: list[tuple[bool, str]]) -> Column:
    keep = F.lit(True)
    for again, pattern in patterns:
        keep = F.when(path.rlike(pattern), F.lit(again)).otherwise(keep)
    return keep


def kept_folders(path: Column, exclude: tuple[str, ...] = (), include: tuple[str, ...] = ()) -> Column:
    """No folder of the path is excluded: by its exact name, or by its ending for names like *.ext."""
    names = sorted({*EXCLUDED, *exclude} - set(include))
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    exact = F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names if not n.startswith("*")]))
    ends = F.exists(folders, lambda f: f.rlike("(" + "|".join(re.escape(n[1:]) for n in names if n.startswith("*")) + ")$"))
    return ~exact & ~ends


def python_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), include: tuple[str, ...] = (), gitignore: bool = True) -> DataFrame:
    """All .py files below root, without excluded and git-ignored ones; an ``include`` name takes a folder back. Paths are relative to root."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{re.escape(base)}/", "")
    rows = reader.option("pathGlobFilter", "*.py").load(root).select(relative.alias("path"), F.decode("content", "utf-8").alias("source")).where(kept_folders(F.col("path"), exclude, include))
    if gitignore:
        patterns = [p for folder, text in _gitignores(spark, root) for p in ignore_pattern(text.split("\n"), folder)]
        if patterns:
            rows = rows.where(not_ignored(F.col("path"), patterns))
    return rows


def _gitignores(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """Folder and text of every .gitignore below root, outer ones first. Spark's readers skip hidden files, so they are listed by the file system."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, each = system.makeQualified(at).toString().rstrip("/"), [], system.listFiles(at, True)
    while each.hasNext():
        path = each.next().getPath()
        if path.getName() == ".gitignore":
            stream = system.open(path)
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.append((path.getParent().toString()[len(base) :].strip("/"), text))
    return sorted(found, key=lambda f: (f[0].count("/") + bool(f[0]), f[0]))


def common_root(paths: list[str]) -> str:
    """The folder that all the given files and folders lie in."""
    return os.path.commonpath([os.path.abspath(p) if os.path.isdir(p) else os.path.dirname(os.path.abspath(p)) for p in paths])


def many_paths(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Files and folders together; paths are relative to their common root, and a file given twice counts once."""
    root = common_root(paths)
    parts = []
    for p in map(os.path.abspath, paths):
        rows = python_files(spark, p, **options) if os.path.isdir(p) else spark.read.format("binaryFile").load(p).select(F.lit(os.path.basename(p)).alias("path"), F.decode("content", "utf-8").alias("source"))
        inner = os.path.relpath(p if os.path.isdir(p) else os.path.dirname(p), root)
        parts.append(rows if inner == "." else rows.withColumn("path", F.concat(F.lit(f"{inner}/"), "path")))
    return reduce(DataFrame.union, parts).dropDuplicates(["path"])


def snippets(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(sources.items()), "path string, source string")


_CELL = "array<struct<cell_type:string,source:string>>"


def notebook_code(notebooks: DataFrame) -> DataFrame:
    """Code cells of ``(path, json)`` rows (nbformat 4), joined by blank lines in order; unreadable notebooks have none."""
    cells = F.from_json("json", f"cells {_CELL}, worksheets array<struct<cells:{_CELL}>>")
    each = notebooks.select("path", F.coalesce(cells["cells"], cells["worksheets"][0]["cells"]).alias("cells"))
    code = F.transform(F.filter("cells", lambda c: c["cell_type"] == "code"), lambda c: F.coalesce(F.array_join(F.from_json(c["source"], "array<string>"), ""), c["source"]))
    return each.where("cells is not null").select("path", F.array_join(code, "\n\n").alias("source"))


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """``(path, cell, source)`` of the code cells of ``(path, json)`` rows, numbered among all cells from 0."""
    cells = F.from_json("json", f"cells {_CELL}, worksheets array<struct<cells:{_CELL}>>")
    each = notebooks.select("path", F.posexplode(F.coalesce(cells["cells"], cells["worksheets"][0]["cells"])).alias("cell", "c")).where("c.cell_type = 'code'")
    return each.select("path", "cell", F.coalesce(F.array_join(F.from_json("c.source", "array<string>"), ""), "c.source").alias("source"))
