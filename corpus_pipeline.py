"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.byte_bpe import tokens_stage
from ledgerloom.llm.decontaminate import decontamination_stage
from ledgerloom.llm.jaccard_join import near_duplicates_stage
from ledgerloom.llm.pii_surrogates import pii_stage
from ledgerloom.llm.quality_qda import quality_stage
from ledgerloom.plans.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("surrogates for personal data", pii_stage),
    ("byte-level BPE", tokens_stage),
]

ORACLE_SQL = None  # SQL cannot express the stages; they are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written before the next one begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i + 1}")
    return docs
