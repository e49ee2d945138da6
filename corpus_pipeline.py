"""A corpus pipeline in five stages: quality rules, near duplicates, benchmark passages, source mix, shards.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; ``run`` writes each stage's
rows as Parquet into the shared folder and reads them back for the next one; what a stage has read or put there itself is removed when its
rows are written. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from erspark.llm import decontam, mixing, quality, sharding, simhash
from erspark.llm.common import table
from erspark.plans.lineage import replaced
from erspark.plans.shipping import importable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or a certified threshold go."""
    importable(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays, that with the smallest doc_id."""
    importable(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as one row per document and copy."""
    return mixing.mixed_texts(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", shards),
]

#: The near-duplicate stage hashes by XXH64, which DuckDB lacks; tests/llm holds a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = replaced(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}", path)
    return STAGES[-1][1](spark, docs, sf_dir)
