"""Line metrics of sources and whole-project sums."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cc_rank, lines, maintainability, mi_rank


def raw_metrics(files: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, loc, sloc, comments, blank)`` by text alone: blank lines, lines that start with # and all others.

    A text that ends in a line break has a last, blank line. Null texts give no row; the empty text has one blank line.
    """
    each = lines(files.where(F.col(key).isNotNull()), key, text).withColumn("bare", F.trim("text"))
    blank, comment = F.col("bare") == "", F.startswith("bare", F.lit("#"))
    return each.groupBy(key).agg(
        F.count(F.lit(1)).alias("loc"),
        F.count_if(~blank & ~comment).alias("sloc"),
        F.count_if(comment).alias("comments"),
        F.count_if(blank).alias("blank"),
    )


_RAW = "path string, loc long, sloc long, comments long, single_comments long, multi long, blank long"


def source_lines(source: str) -> tuple[int, ...]:
    """loc, sloc, comments, single_comments, multi and blank of a Python source.

    Lines that are not blank and lie in a string of several lines are multi, unless they begin with a # outside of strings; sloc
    is multi and code. A # after code adds to single_comments. A source that doesn't parse has no strings.
    """
    lines = source.split("\n")
    spans: list[tuple[tuple[int, int], tuple[int, int]]] = []
    try:
        for n in ast.walk(ast.parse(source)):
            if isinstance(n, (ast.JoinedStr, ast.Constant)) and (isinstance(n, ast.JoinedStr) or isinstance(n.value, (str, bytes))):
                spans.append(((n.lineno, n.col_offset), (n.end_lineno, n.end_col_offset)))
    except (SyntaxError, ValueError, RecursionError):
        pass
    kinds = ["blank" if not x.strip() else "code" for x in lines]
    for (a, _), (b, _) in spans:
        if b > a:
            for k in range(a - 1, b):
                kinds[k] = "multi" if kinds[k] != "blank" else "blank"
    after = 0
    for k, line in enumerate(lines):
        if kinds[k] == "blank" or "#" not in line:
            continue
        at = (k + 1, len(line[: line.index("#")].encode()))
        if not any(a <= at < b for a, b in spans):
            if line[: line.index("#")].strip():
                after += 1
            else:
                kinds[k] = "comment"
    count = kinds.count
    return len(lines), count("code") + count("multi"), count("comment"), count("comment") + after, count("multi"), count("blank")


def source_metrics(files: DataFrame) -> DataFrame:
    """``source_lines`` of ``(path, source)`` rows. Rows with a null give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *source_lines(s)) for p, s in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(columns)], [c.split()[0] for c in _RAW.split(", ")])

    return files.select("path", "source").where("path is not null and source is not null").mapInArrow(run, _RAW)


def file_metrics(raw: DataFrame, functions: DataFrame) -> DataFrame:
    """Raw metrics of ``path`` with the sum of its functions' complexity and volume, MI and its rank."""
    per_file = functions.groupBy("path").agg(F.sum("cc").alias("complexity"), F.sum("volume").alias("volume"))
    joined = raw.join(per_file, "path", "left").na.fill(0, ["complexity", "volume"])
    mi = maintainability(F.col("volume"), F.col("complexity"), F.col("sloc"), F.col("comments"))
    return joined.withColumn("mi", mi).withColumn("mi_rank", mi_rank(F.col("mi")))


def ranked(functions: DataFrame) -> DataFrame:
    return functions.withColumn("rank", cc_rank(F.col("cc")))


def quality_gates(metrics: DataFrame, unused: DataFrame, definitions: DataFrame, most_unused: float = 5.0, most_complexity: int = 10, least_mi: float = 40.0) -> DataFrame:
    """``(gate, actual, threshold, passed)``: share of unused definitions, largest complexity, mean MI."""
    worst = metrics.agg(F.coalesce(F.max("complexity"), F.lit(0)).cast("double").alias("c"), F.coalesce(F.avg(F.when(F.col("mi") > 0, F.col("mi"))), F.lit(0.0)).alias("m"))
    every = definitions.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("d"))
    share = unused.agg(F.count(F.lit(1)).alias("n")).crossJoin(every).select((F.col("n") * 100 / F.col("d")).alias("u"))
    row = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), a.alias("actual"), F.lit(float(t)).alias("threshold"), p.alias("passed")) for g, a, t, p in (
        ("unused_percent", F.col("u"), most_unused, F.col("u") <= most_unused),
        ("max_complexity", F.col("c"), most_complexity, F.col("c") <= most_complexity),
        ("min_mi", F.col("m"), least_mi, F.col("m") >= least_mi),
    )]))
    return worst.crossJoin(share).select(row.alias("g")).select("g.*")
