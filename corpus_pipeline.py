"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbtide.llm import stages
from ebbtide.llm.common import table
from ebbtide.runtime import materialize

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("byte_bpe", stages.byte_bpe),
]

# The model, the alignment and the tokens have no SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; what a stage returns is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
