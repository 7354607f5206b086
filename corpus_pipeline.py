"""A training corpus from raw documents: rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import decontaminate, mixing, near_dedup, quality_rules, sharding
from chronofold.llm.common import Scratch

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]
#: No SQL: the rules of the first stage are learned.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each to all that its predecessor kept, written once and dropped when it is read."""
    work = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = work.keep(stage(spark, docs, sf_dir))
        work.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
