"""Cutting a plan's lineage with a table written to the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent in a local session (as in tests) is a folder of this
    machine made and remembered in the session; on a cluster its absence is an error.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """The path of a folder of its own in the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/ledgerloom/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str | None = None, tidy: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a frame that reads it.

    What is read later does not depend on any executor that made it. The schema is passed
    on, so an empty table reads back as well. ``compression`` names a codec of Parquet's.
    With ``tidy`` the shuffle files of the write go when it ends, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, tag)
    before = spark.conf.get(TIDY, "false")
    try:
        if tidy:
            spark.conf.set(TIDY, "true")
        df.write.parquet(path, compression=compression)
    finally:
        if tidy:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """What a store of Parquet files holds so far; None if nothing was written to it."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
