"""Files of exported events: manifest, admission, and the scan of multi-event envelopes."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import path_kind

MAX_BYTES = 64 * 1024 * 1024
SCANNED = "file string, record_number long, raw_xml string, state string, diagnostic string"


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, size, modification time and SHA-256 of every file under a path; Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("path").alias("file"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"),
    )


def admit_files(manifest: DataFrame, max_bytes: int = MAX_BYTES, kinds: Sequence[str] = ()) -> DataFrame:
    """Adds why a file is not admitted (null if it is): its path's kind, extension, emptiness or size, the first that holds.

    ``kinds`` are the kinds of path (see ``path_kind``) that may be read; none: any. They are
    judged by ``origin``, the path as the user gave it, if the manifest has it.
    """
    foreign = ~path_kind(F.col("origin")).isin(*kinds) if kinds and "origin" in manifest.columns else F.lit(False)
    return manifest.withColumn(
        "rejected",
        F.when(foreign, "path_kind_not_allowed").when(~F.lower("name").endswith(".xml"), "unsupported_extension").when(F.col("size") == 0, "empty_file").when(F.col("size") > max_bytes, "file_too_large"),
    )


def skip_imported(manifest: DataFrame, imports: DataFrame) -> DataFrame:
    """Adds ``already_imported``: whether a file with the same content was imported before."""
    known = imports.select("sha256").distinct().withColumn("already_imported", F.lit(True))
    return manifest.join(known, "sha256", "left").withColumn("already_imported", F.coalesce("already_imported", F.lit(False)))


def _records(content: bytes, namespace: str, root_name: str, max_bytes: int) -> Iterator[tuple[int | None, str | None, str, str | None]]:
    if len(content) > max_bytes:
        yield None, None, "fatal", "file_too_large"
        return
    if b"<!DOCTYPE" in content:
        yield None, None, "fatal", "document_type_refused"
        return
    number, depth, root = 0, 0, None
    try:
        for event, element in ET.iterparse(io.BytesIO(content), events=("start", "end")):
            depth += 1 if event == "start" else -1
            if event == "start" and depth == 1:
                root = element
                if element.tag != f"{{{namespace}}}{root_name}" or element.get("formatVersion") != "1":
                    yield None, None, "fatal", "invalid_envelope"
                    return
            elif event == "end" and depth == 1:
                number += 1
                if element.tag != f"{{{namespace}}}Record":
                    yield None, None, "fatal", "unexpected_element"
                    return
                sound = not element.attrib and not len(element) and (element.text or "").strip()
                yield number, (element.text or "").strip() if sound else None, "available" if sound else "unavailable", None if sound else "invalid_record"
                root.remove(element)
    except ET.ParseError:
        yield None, None, "fatal", "malformed_xml"


def scan_envelopes(spark: SparkSession, path: str, namespace: str, root_name: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(file, record_number, raw_xml, state, diagnostic): the records of every envelope file, numbered from 1.

    An envelope's root is called ``root_name`` and lies in ``namespace``, has ``formatVersion="1"`` and holds ``Record``
    elements only, each with nothing but text. A file is one task's input and is parsed
    incrementally; files above ``max_bytes`` are refused, which bounds a task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.select("path", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"), "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content, _ in batch.itertuples(index=False):
                found = [(None, None, "fatal", "file_too_large")] if content is None else list(_records(content, namespace, root_name, max_bytes))
                if found:
                    yield pd.DataFrame([(file, *r) for r in found], columns=["file", "record_number", "raw_xml", "state", "diagnostic"])

    return small.mapInPandas(run, SCANNED)
