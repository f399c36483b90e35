"""Totals over files and the project: sums, averages, counts by category, health score, view levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import severity_rank


def metric_sums(raw: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: files, loc, sloc, comments, blank, and the sums of h1, h2, n1, n2, volume and effort of all functions."""
    lines = raw.agg(F.count(F.lit(1)).alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("loc", "sloc", "comments", "blank")))
    work = functions.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("h1", "h2", "n1", "n2", "volume", "effort")))
    return lines.crossJoin(work)  # one row each


def averages(metrics: DataFrame) -> DataFrame:
    """Mean complexity of files with any and mean MI of files with one above 0; 0 without such files."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))
    return metrics.agg(mean("complexity").alias("average_complexity"), mean("mi").alias("average_mi"))


def complexity_average(functions: DataFrame) -> DataFrame:
    return functions.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.avg("cc"), F.lit(0.0)).alias("average"))


def category_counts(findings: DataFrame) -> DataFrame:
    """``(category, severity, severity_rank, n)`` of routed findings."""
    return findings.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n")).withColumn("severity_rank", severity_rank(F.col("severity")).cast("int"))


def file_totals(files: DataFrame, unused: DataFrame, *findings: DataFrame) -> DataFrame:
    """``(path, issues, unused, total)`` of every file: findings of all kinds, and unused definitions."""
    issues = reduce(DataFrame.union, [f.select("path") for f in findings]).groupBy("path").agg(F.count(F.lit(1)).alias("issues"))
    dead = unused.groupBy("path").agg(F.count(F.lit(1)).alias("unused"))
    joined = files.select("path").join(issues, "path", "left").join(dead, "path", "left").na.fill(0, ["issues", "unused"])
    return joined.withColumn("total", F.col("issues") + F.col("unused"))


def project_stats(raw: DataFrame, defs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: files, folders, kilobytes, lines, functions (of modules and their classes) and classes."""
    size = sources.agg(F.count(F.lit(1)).alias("files"), F.count_distinct(F.regexp_replace("path", "[^/]*$", "")).alias("folders"), F.round(F.sum(F.octet_length("source")) / 1024, 3).alias("kilobytes"))
    loc = raw.agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))
    classes = defs.where("def_type = 'class'").select(F.col("full_name").alias("parent")).distinct()
    top = defs.where("def_type in ('function', 'method') and parent = module").select("full_name")
    inner = defs.where("def_type = 'method'").join(classes, "parent", "left_semi").select("full_name")
    return size.crossJoin(loc).crossJoin(top.union(inner).agg(F.count(F.lit(1)).alias("functions"))).crossJoin(defs.agg(F.count_if(F.col("def_type") == "class").alias("classes")))


def halstead_level(column: Column, low: float, medium: float, high: float) -> Column:
    """low, medium, high or very high by three bounds."""
    return F.when(column < low, "low").when(column < medium, "medium").when(column < high, "high").otherwise("very high")


def halstead_levels(functions: DataFrame) -> DataFrame:
    """Levels of volume (100, 1000, 8000), difficulty (10, 20, 30), effort (1e3, 1e4, 1e5) and bugs (.05, .5, 1)."""
    bounds = {"volume": (100, 1000, 8000), "difficulty": (10, 20, 30), "effort": (1e3, 1e4, 1e5), "bugs": (0.05, 0.5, 1)}
    return functions.withColumns({f"{c}_level": halstead_level(F.col(c), *b) for c, b in bounds.items()})


WEIGHTS = {"complexity": 0.35, "maintainability": 0.25, "security": 0.15, "reliability": 0.15, "style": 0.10}


def health_score(counts: DataFrame) -> DataFrame:
    """``(score, grade)`` from one row of penalties a category (0 to 100 each, capped): 100 less their weighted sum; A from 90, B 75, C 60, D 40, else F."""
    lost = reduce(lambda a, b: a + b, [F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))) * w for c, w in WEIGHTS.items()])
    score = F.round(100 - lost, 2)
    return counts.select(score.alias("score")).withColumn("grade", grade(F.col("score")))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def category_grade(score: Column) -> Column:
    """The letter of one category, which has no D."""
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("F")


def clone_summary(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: groups, instances, pairs by type, files, mean size of a group. groups is ``(place, group_place)``."""
    own = groups.agg(F.count_distinct("group_place").alias("groups"), F.count(F.lit(1)).alias("instances"), F.count_distinct("place.path").alias("files"))
    types = pairs.agg(*(F.count_if(F.col("clone_type") == t).alias(t.lower()) for t in ("T1", "T2", "T3")))
    return own.crossJoin(types).withColumn("mean_size", F.when(F.col("groups") > 0, F.col("instances") / F.col("groups")).otherwise(0.0))


def clone_majority(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(group_place, clone_type, similarity)``: the type of most pairs of a group (T1 before T2 before T3 if equal) and their mean similarity."""
    own = pairs.join(groups.select(F.col("place").alias("a"), "group_place"), "a").groupBy("group_place").agg(*(F.count_if(F.col("clone_type") == t).alias(t) for t in ("T1", "T2", "T3")), F.avg("similarity").alias("similarity"))
    most = F.greatest("T1", "T2", "T3")
    return own.select("group_place", F.when(F.col("T1") == most, "T1").when(F.col("T2") == most, "T2").otherwise("T3").alias("clone_type"), "similarity")
