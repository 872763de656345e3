"""Repeated deliveries of any age."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import adapter
from ledgerloom.streaming import capture, redelivery

SF = "/root/testdata/sf0.001"
SCHEMA = "live_evidence_id string, occurred_ts long, v string"


def stored(spark, path, n):
    return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(f"{path}/batch_id={n}").collect()), key=str)


def buckets_of(spark, ids, buckets):
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    return {r.bucket for r in redelivery._with_bucket(rows, "id", buckets).collect()}


def replace(files, content=None):
    """Writes other contents, or each file's own again, and drops the checksums beside them."""
    for f, own in files.items():
        with open(f, "wb") as out:
            out.write(own if content is None else content)
        folder, name = os.path.split(f)
        for crc in glob.glob(f"{folder}/.{name}.crc"):
            os.remove(crc)


def test_a_repeat_after_hours_is_dropped_and_only_its_bucket_read(spark, tmp_path):
    path, ledger = str(tmp_path / "rows"), str(tmp_path / "ledger")
    hour = 3_600_000_000
    batch = lambda rows: spark.createDataFrame(rows, SCHEMA)
    put = lambda rows, n: redelivery.append_first_deliveries(batch(rows), n, path, ledger, buckets=16, ids_per_bucket=1000)
    put([(f"a:{i}", i, "x") for i in range(200)] + [("a:3", -1, "first"), (None, 0, "n"), (None, 0, "n")], 0)
    zero = stored(spark, path, 0)
    assert len(zero) == 202 and ("a:3", -1, "first") in zero and zero.count((None, 0, "n")) == 2
    # every bucket but that of a:7 is made unreadable: whoever opened one would fail
    (held,) = buckets_of(spark, ["a:7"], 16)
    others = [f for f in glob.glob(f"{ledger}/ids/batch_id=0/bucket=*/*.parquet") if f"/bucket={held}/" not in f]
    assert len(others) == 15
    sound = {f: open(f, "rb").read() for f in others}
    replace(sound, b"not parquet")
    fresh = [(f"b:{i}", 30 * hour + i, "y") for i in range(300)]
    for _ in range(2):  # a repeated batch changes nothing
        put([*fresh, ("a:7", 30 * hour, "again"), (None, 1, "n")], 1)
        assert stored(spark, path, 1) == sorted([*fresh, (None, 1, "n")], key=str)
    replace(sound)
    put([], 5)  # numbers may be left out, and an empty batch passes the filters on
    put([("a:1", 0, "z"), ("b:299", 0, "z"), ("c:1", 0, "z")], 6)
    assert stored(spark, path, 5) == [] and stored(spark, path, 6) == [("c:1", 0, "z")]
    with pytest.raises(ValueError, match="another number of buckets"):
        redelivery.append_first_deliveries(batch([("d", 0, "z")]), 7, path, ledger, buckets=8)


def test_full_filters_only_let_more_be_read(spark, tmp_path):
    path, ledger = str(tmp_path / "rows"), str(tmp_path / "ledger")
    for n, ids in enumerate((range(0, 500), range(250, 750))):
        rows = spark.createDataFrame([(f"é{i}", i, None) for i in ids], SCHEMA)
        redelivery.append_first_deliveries(rows, n, path, ledger, buckets=2, ids_per_bucket=2)
    assert len(stored(spark, path, 0)) == 500 and {r[0] for r in stored(spark, path, 1)} == {f"é{i}" for i in range(500, 750)}


def test_a_stream_delivered_twice_is_stored_once(spark, tmp_path):
    rows = adapter.audit_rows(spark, SF).select(
        F.concat_ws(":", "live_session_id", F.col("received_sequence").cast("string")).alias("live_evidence_id"), "occurred_ts", "outcome"
    )
    source = str(tmp_path / "in")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = capture.read_live(spark, source, rows.schema)
    redelivery.first_delivery_sink(stream, str(tmp_path / "out"), str(tmp_path / "ledger"), str(tmp_path / "cp"), buckets=8).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.batch_id for r in out.select("batch_id").distinct().collect()} <= {0, 1}
    assert sorted(map(str, out.drop("batch_id").collect())) == sorted(map(str, rows.collect()))
