"""Reading the tables that the registered queries work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: str, folds: int) -> Column:
    """The fold of a row: the CRC-32 of its id, as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string")) % folds
