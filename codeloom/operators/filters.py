"""What is kept of findings and definitions: ignores by path, whitelists, taint lines, ranks; and their order."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TAINT_SENSITIVE = ("D101", "D102", "D402", "D501")
#: Names that frameworks call; active only beside a whitelist of the user.
BUILTIN_NAMES = ("setUp", "tearDown", "setUpClass", "tearDownClass", "setUpModule", "tearDownModule", "add_argument", "getLogger", "do_GET", "do_POST", "emit", "__init_subclass__", "model_config", "Meta", "upgrade", "downgrade")
_ENTRY = "name string, pattern string, file string, source string"


def glob_pattern(glob: str) -> str:
    """A regular expression for a path or name glob: ** crosses folders, * and ? don't, [..] are classes; one without a slash matches at any depth."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob[k : k + 3] == "**/":
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob[k : k + 2] == "**":
            out, k = out + ".*", k + 2
            continue
        end = glob.find("]", k + 1)
        if c == "[" and end > 0:
            out, k = out + "[" + glob[k + 1 : end].replace("!", "^", 1) + "]", end + 1
            continue
        out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), k + 1
    return ("^" if "/" in glob else "(?:^|/)") + out.removeprefix("/") + "$"


def without_ignored(findings: DataFrame, ignores: dict[str, tuple[str, ...]]) -> DataFrame:
    """Findings without those whose path matches a glob that ignores their rule id (or ALL)."""
    keep = F.lit(True)
    for glob, ids in ignores.items():
        hit = F.col("path").rlike(glob_pattern(glob))
        keep = keep & ~(hit & (F.lit("ALL" in ids) | F.col("rule_id").isin(*ids)))
    return findings.where(keep)


def whitelist(spark: SparkSession, entries: list[tuple[str, str, str | None]], external: list[tuple[str, str, str | None]] = ()) -> DataFrame:
    """``(name, pattern, file, source)`` of entries (name, exact / wildcard / regex, path glob or None), those of other files, and the built-in ones if there is any."""
    rows = [(n, p, f, "user") for n, p, f in entries] + [(n, p, f, "external") for n, p, f in external]
    return spark.createDataFrame(rows + ([(n, "exact", None, "builtin") for n in BUILTIN_NAMES] if rows else []), _ENTRY)


def without_whitelisted(defs: DataFrame, entries: DataFrame, name: str = "simple") -> DataFrame:
    """Definitions whose name no entry matches. Exact names are an anti-join; patterns, which are few, become one condition."""
    exact = entries.where("pattern = 'exact' and file is null").select(F.col("name").alias("__name")).distinct()
    kept = defs.join(F.broadcast(exact), defs[name] == exact["__name"], "left_anti")
    keep = F.lit(True)
    for r in entries.where("pattern <> 'exact' or file is not null").collect():  # a configuration file's entries
        hit = F.col(name) == r.name if r.pattern == "exact" else F.col(name).rlike(r.name if r.pattern == "regex" else glob_pattern(r.name).replace("(?:^|/)", "^"))
        keep = keep & ~(hit & (F.col("path").rlike(glob_pattern(r.file)) if r.file else F.lit(True)))
    return kept.where(keep)


def whitelist_lines(unused: DataFrame) -> DataFrame:
    """A whitelist of unused definitions as ``value`` lines in order: the name, with where it is."""
    simple = F.substring_index("full_name", ".", -1)
    return unused.orderBy("path", "line", "full_name").select(F.format_string("%s  # unused %s (%s:%d)", simple, "def_type", "path", "line").alias("value"))


def only_tainted(findings: DataFrame, flows: DataFrame) -> DataFrame:
    """Findings of the taint-sensitive ids only on lines that taint reaches, all others as they are."""
    sinks = flows.select("path", F.col("sink_line").alias("line")).distinct()
    sensitive = F.col("rule_id").isin(*TAINT_SENSITIVE)
    return findings.where(~sensitive).unionByName(findings.where(sensitive).join(sinks, ["path", "line"], "left_semi"))


def between_ranks(df: DataFrame, best: str = "A", worst: str = "F", column: str = "rank") -> DataFrame:
    return df.where(F.col(column).between(best, worst))


def ordered(findings: DataFrame) -> DataFrame:
    """Findings, secrets, errors or flows in the order of reports: by path and the place they have."""
    keys = [c for c in ("path", "line", "sink_line", "col", "rule_id", "message") if c in findings.columns]
    return findings.orderBy(*keys)


def ordered_functions(functions: DataFrame, by: str = "score") -> DataFrame:
    """By complexity (highest first), by lines or by name; ties by line, then name."""
    keys = {"score": [F.desc("cc"), "line", "name"], "lines": ["line", "name"], "alpha": ["name", "line"]}
    if by not in keys:
        raise ValueError(f"{by} is none of {tuple(keys)}")
    return functions.orderBy(*keys[by])


def most_similar_clone(findings: DataFrame) -> DataFrame:
    """One clone finding for each path and line, the most similar; then the first rule id."""
    best = Window.partitionBy("path", "line").orderBy(F.desc("similarity"), "rule_id", "message")
    return findings.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
