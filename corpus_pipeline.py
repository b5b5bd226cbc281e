"""The corpus pipeline: each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import pipeline_stages as stages
from palimpsest.llm.shared import table, written

STAGES = [
    ("quality rules", stages.quality_rules),
    ("simhash near-dedup", stages.near_dedup),
    ("benchmark decontamination", stages.decontamination),
    ("secret scans", stages.secret_scans),
    ("bpe", stages.bpe),
]

#: Fingerprints, automata, trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = written(out) if k + 1 < len(STAGES) else out
    return docs
