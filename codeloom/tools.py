"""Whole analyses as single calls: of a path, of a snippet, and of metrics alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import lines, without_suppressed
from .operators import deadcode, facts, filters, metrics, rules, secrets
from .sources import files as sources
from .sources.config import Config


def analyze(files: DataFrame, config: Config | None = None) -> dict[str, DataFrame]:
    """Findings, secrets, unused definitions, errors and metrics of ``(path, source)`` rows, by name."""
    config = config or Config()
    table = facts.facts(files)
    text = lines(files, "path", "source")
    found = rules.all_findings(table, n_args=config.max_args, length=config.max_lines, mccabe=config.max_complexity)
    found = without_suppressed(found, text, "path").where(~F.col("rule_id").isin(*config.ignore))
    assigned = table.where("kind = 'assign'").select("path", "line", "name", F.col("message").alias("value"))
    documented = table.where("kind = 'docstring'").select("path", F.explode(F.sequence("line", "end_line")).alias("line"))
    custom, _ = secrets.valid_patterns(files.sparkSession, config.custom_secrets)
    raw = metrics.source_metrics(files)
    dead = deadcode.unused(deadcode.symbols(files), config.confidence, config.include_tests).withColumn("simple", F.substring_index("full_name", ".", -1))
    per_file = metrics.file_metrics(raw, facts.functions(table))
    if config.min_mi is not None:
        found = found.unionByName(rules.maintainability_findings(per_file, config.min_mi))
    return {
        "findings": filters.ordered(filters.without_ignored(rules.routed(found), config.per_file_ignores)),
        "secrets": filters.ordered(secrets.secret_findings(files, "path", "source", path="path", custom=custom, assigned=assigned, docstrings=documented)),
        "unused": filters.without_whitelisted(dead, filters.whitelist(files.sparkSession, list(config.whitelist))).drop("simple"),
        "errors": filters.ordered(table.where("kind = 'error'").select("path", "line", "message")),
        "metrics": per_file,
    }


def analyze_path(spark: SparkSession, path: str, config: Config | None = None) -> dict[str, DataFrame]:
    config = config or Config()
    return analyze(sources.python_files(spark, path, config.exclude_folders, config.include_folders), config)


def analyze_code(spark: SparkSession, code: str, path: str = "snippet.py", config: Config | None = None) -> dict[str, DataFrame]:
    return analyze(sources.snippets(spark, {path: code}), config)


def quick_scan(spark: SparkSession, path: str) -> DataFrame:
    """Secrets and danger findings alone, ``(path, line, rule_id, severity, message)``."""
    files = sources.python_files(spark, path)
    columns = ("path", "line", "rule_id", "severity", "message")
    danger = rules.danger_findings(facts.facts(files, "call", "import", "finding"))
    return filters.ordered(danger.select(*columns).unionByName(secrets.secret_findings(files, "path", "source", path="path").select(*columns)))


def cyclomatic_complexity(spark: SparkSession, path: str) -> DataFrame:
    return filters.ordered_functions(metrics.ranked(facts.functions(facts.facts(sources.python_files(spark, path), "function"))))


def maintainability_index(spark: SparkSession, path: str) -> DataFrame:
    files = sources.python_files(spark, path)
    return metrics.file_metrics(metrics.source_metrics(files), facts.functions(facts.facts(files, "function"))).select("path", "mi", "mi_rank")
