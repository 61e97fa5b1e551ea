"""The corpus pipeline: documents go through the stages in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddlens.llm import decontaminate, jaccard, mixing, quality, suffix_dedup
from oddlens.llm.common import written

STAGES = [
    ("quality rules", quality.quality_stage),
    ("n-gram Jaccard join", jaccard.jaccard_stage),
    ("suffix-array dedup", suffix_dedup.suffix_stage),
    ("benchmark decontamination", decontaminate.decontamination_stage),
    ("mixing", mixing.mixing_stage),
]
#: Approximate searches and random draws are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
