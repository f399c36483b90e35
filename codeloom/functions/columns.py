"""Column expressions shared by the operators; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
TEST_PATH = r"(^|/)tests?/|(^|/)test_[^/]*[.]py$|_test[.]py$|(^|/)conftest[.]py$"
FRAMEWORK_PATH = r"(views|handlers|endpoints|routes|api|urls|function_app)[.]py$"
_SUPPRESS = r"(?i)#\s*(?:noqa|ignore)(?::\s*([A-Za-z0-9_\-]+(?:\s*,\s*[A-Za-z0-9_\-]+)*))?"


def lines(files: DataFrame, key: str, text: str, test: Column | None = None) -> DataFrame:
    """``(key, line, text)``: one row a line, numbered from 1. A null text has no lines, an empty one has one. ``test`` is carried as a flag of that name."""
    flag = [] if test is None else [test.alias("test")]
    each = files.select(F.col(key), *flag, F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "text"))
    return each.select(key, (F.col("at") + 1).alias("line"), "text", *[F.col("test")] * len(flag))


def severity_rank(severity: Column) -> Column:
    """CRITICAL 4 to LOW 1; 0 for anything else."""
    rank = F.lit(0)
    for k, name in enumerate(SEVERITIES, 1):
        rank = F.when(F.upper(severity) == name, k).otherwise(rank)
    return rank


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_framework_path(path: Column) -> Column:
    return path.rlike(FRAMEWORK_PATH)


def module_name(path: Column) -> Column:
    """pkg/mod.py to pkg.mod; a package's __init__ is the package."""
    bare = F.regexp_replace(F.regexp_replace(path, r"[.](py|ipynb)$", ""), "^/+", "")
    return F.regexp_replace(F.regexp_replace(bare, "/", "."), r"(^|[.])__init__$", "")


def byte_entropy(text: Column) -> Column:
    """Shannon entropy of the UTF-8 bytes in bits; 0 for the empty text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))
    n = F.size(pairs).cast("double")
    counts = F.transform(F.array_distinct(pairs), lambda x: F.size(F.filter(pairs, lambda y: y == x)) / n)
    return F.coalesce(F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def redacted(text: Column) -> Column:
    """The first and last four characters of a long text, stars for one of up to 8 bytes."""
    return F.when(F.octet_length(text) <= 8, F.repeat(F.lit("*"), F.length(text))).otherwise(F.concat(F.substring(text, 1, 4), F.lit("..."), F.right(text, F.lit(4))))


def suppressed_codes(text: Column, word: str = "codeloom") -> Column:
    """What a line's comment suppresses: null for nothing, an empty array for everything, else upper-case ids.

    Everything: ``# pragma: no`` with exactly the given word, a bare ``# noqa`` or ``# ignore``, or the code CSP.
    """
    codes = F.transform(F.split(F.upper(F.regexp_extract(text, _SUPPRESS, 1)), r"\s*,\s*"), lambda x: F.trim(x))
    every = (F.regexp_extract(text, _SUPPRESS, 1) == "") | F.array_contains(codes, "CSP")
    return F.when(text.rlike(rf"(?i)#\s*pragma:\s*no\s+{word}\b"), F.array().cast("array<string>")).when(text.rlike(_SUPPRESS), F.when(every, F.array().cast("array<string>")).otherwise(codes))


def without_suppressed(findings: DataFrame, all_lines: DataFrame, key: str) -> DataFrame:
    """Findings ``(key, line, rule_id, ...)`` whose line doesn't suppress them; all_lines is ``(key, line, text)``."""
    marks = all_lines.select(key, "line", suppressed_codes(F.col("text")).alias("codes")).where("codes is not null")
    gone = findings.join(marks, [key, "line"]).where("size(codes) = 0 or array_contains(codes, rule_id)").select(key, "line", "rule_id").distinct()
    return findings.join(gone, [key, "line", "rule_id"], "left_anti")


def cc_rank(complexity: Column) -> Column:
    out = F.lit("F")
    for most, rank in ((40, "E"), (30, "D"), (20, "C"), (10, "B"), (5, "A")):
        out = F.when(complexity <= most, rank).otherwise(out)
    return out


def mi_rank(mi: Column) -> Column:
    return F.when(mi >= 20, "A").when(mi >= 10, "B").otherwise("C")


def maintainability(volume: Column, complexity: Column, sloc: Column, comments: Column) -> Column:
    """171 - 5.2 ln V - 0.23 CC - 16.2 ln SLOC + 50 sin(sqrt(2.4 comments / SLOC)) within 0 to 100; terms of 0 drop out."""
    v = F.when(volume > 0, 5.2 * F.log(volume)).otherwise(0.0)
    s = F.when(sloc > 0, 16.2 * F.log(sloc)).otherwise(0.0)
    c = F.when((sloc > 0) & (comments > 0), 50 * F.sin(F.sqrt(2.4 * comments / sloc))).otherwise(0.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 171 - v - 0.23 * complexity - s + c))
