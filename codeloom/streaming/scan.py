"""Secret scanning of a stream of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lines
from ..operators.secrets import MIN_SCORE, context_score, pattern_hits


def streamed_secrets(files: DataFrame, key: str, text: str) -> DataFrame:
    """Pattern hits of a streaming DataFrame that score MIN_SCORE or more; stateless, so any output mode works."""
    hits = pattern_hits(lines(files.where(F.col(key).isNotNull()), key, text), key)
    return hits.withColumn("confidence", context_score(F.col("base"), F.col("text"))).where(F.col("confidence") >= MIN_SCORE).select(key, "line", "rule_id", "severity", "confidence")
