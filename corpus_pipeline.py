"""The corpus pipeline: STAGES in order, each a function of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salegrain.llm.common import Scratch, workers_can_import
from salegrain.llm.stages import decontaminate_stage, line_stage, near_dedup_stage, packing_stage, quality_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can neither train the classifier nor count the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the folder's documents; each stage's result is written to the shared folder and read again."""
    workers_can_import(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
