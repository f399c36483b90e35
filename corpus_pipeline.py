"""The corpus pipeline: raw documents to packed training windows.

Each stage gets the documents that its predecessor kept, written and read
again in between, and all but the last return the columns of documents, whatever else these are named.
Empty tables go through all stages. Rows are judged one by one, so repeated rows share their fate
until the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, minhash, packing, quality, toxicity
from codeloom.llm.store import Table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry strength reaches the threshold; equal strengths are all kept. Null, empty and wordless texts go; a null doc_id stays."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lexicon score stays below the toxic threshold; a score at it goes. Null and empty texts score 0 and stay, as do null doc_ids by their text."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of every near-duplicate group, and all others. Rows that share a doc_id become one; null, empty and wordless texts and null doc_ids stay."""
    return minhash.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts, null doc_ids and empty benchmark items match nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows over the remaining documents in order of doc_id, then of a hash of their sentence lengths. Null, empty and tokenless texts and null doc_ids take no place."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Fitting, walks and components can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents in sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = Table(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.drop()
        docs, before = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
