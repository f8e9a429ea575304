"""The corpus pipeline: each stage is one operator of vecinity.llm, its result written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecinity.llm import stages
from vecinity.llm.common import saved

STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup_stage),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("packing", stages.packing_stage),
]

#: Two stages (language ID and packing) have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
