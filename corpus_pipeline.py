"""A training corpus from raw documents: filter, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the docs of the next. All but the last return the
columns of documents. Nulls, repeated rows, empty tables and extra columns are
treated as the operator of each stage says in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrion.llm import decontam, neardup, packing, pii, quality
from papyrion.session import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies, the document with the least id stays."""
    return neardup.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; every document stays."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 2048 tokens, with its ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", packed),
]

#: SQL can express neither the banding nor the packing; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        # What a stage writes on its way goes when its result is written.
        with scratch(spark) as keep:
            docs = keep(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
