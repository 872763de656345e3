"""Several tables published as one: nothing is seen of a publication until its manifest is there.

Each table is written to a folder of its own version, ``root/data/<table>/version=...``. Last
comes one row in ``root/manifests`` (one file, which appears by being renamed). Readers
follow manifests only: of each key the newest counts, so publishing a key again replaces all of
its tables at once, and what a failed run has left is never read. One writer at a time is
expected; two at once both publish, and of the same key the later version counts.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.projection import project_session
from ledgerloom.plans.scratch import stored

MANIFEST = "key string, version string, tables array<string>"


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], key: str | None = None) -> str:
    """Publishes ``tables`` by name, in place of what was published under ``key``, or beside all else if it is None; returns the version."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/data/{name}/version={version}")
    row = spark.createDataFrame([(key if key is not None else version, version, sorted(tables))], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifests")
    return version


def published(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The rows of one table in the newest publication of every key; None if there is none."""
    manifests = stored(spark, f"{root}/manifests", MANIFEST)
    if manifests is None:
        return None
    newest = manifests.groupBy("key").agg(F.max_by(F.struct("version", "tables"), "version").alias("m")).where(F.array_contains("m.tables", name)).select(F.col("m.version").alias("version"))
    rows = stored(spark, f"{root}/data/{name}")
    return None if rows is None else rows.withColumn("version", F.col("version").cast("string")).join(newest, "version", "left_semi").drop("version")


def publish_projection(spark: SparkSession, root: str, records: DataFrame, completions: DataFrame) -> DataFrame:
    """Projects what is new (see ``project_session``) behind the published ``rows`` and publishes them with the ``runs``, all or nothing; returns the runs."""
    appended, runs = project_session(records, completions, published(spark, root, "rows"))
    version = publish(spark, root, {"rows": appended, "runs": runs})
    return spark.read.parquet(f"{root}/data/runs/version={version}")
