"""Training-data pipeline over `documents`: quality rules, language, near copies, benchmark passages, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelkit.llm import stages
from panelkit.session import scratch_path

STAGES = [
    ("quality rules", stages.quality_rules),
    ("language ID", stages.language_id),
    ("MinHash near-dedup", stages.near_dedup),
    ("benchmark decontamination", stages.benchmark_decontamination),
    ("BPE encoding and decoding", stages.bpe),
]

# Models and hashes decide what stays, which SQL cannot express; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each result is written and reread as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
