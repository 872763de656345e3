"""File sources, sinks, XML parsing and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.columns import micros
from ledgerloom.operators import correlate, mart, parse, projection, sessions
from ledgerloom.plans import adapter
from ledgerloom.sources import envelopes, publication, sinks
from ledgerloom.streaming import capture

SF = "/root/testdata/sf0.001"
NS, ROOT = "urn:example:events", "Events"


def envelope(body, version="1", ns=NS):
    return f'<{ROOT} xmlns="{ns}" formatVersion="{version}">{body}</{ROOT}>'


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.xml": envelope("<Record><![CDATA[<x/>]]></Record><Record id='1'>y</Record><Record><b/></Record><Record><![CDATA[p]]><![CDATA[q]]></Record>"),
        "b.xml": envelope("<Record>x</Record>", version="2"),
        "c.xml": "<broken",
        "d.txt": "text",
        "e.xml": "",
        "f.xml": "<!DOCTYPE a><a/>",
        "g.xml": envelope("<Record>x</Record>").replace(ROOT, "Banana"),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_envelopes(spark, folder):
    rows = {}
    for r in envelopes.scan_envelopes(spark, folder, NS, ROOT).collect():
        rows.setdefault(os.path.basename(r.file), []).append((r.record_number, r.raw_xml, r.state, r.diagnostic))
    assert sorted(rows["a.xml"]) == [(1, "<x/>", "available", None), (2, None, "unavailable", "invalid_record"), (3, None, "unavailable", "invalid_record"), (4, "pq", "available", None)]
    assert [rows[f][0][3] for f in ("b.xml", "c.xml", "f.xml", "g.xml")] == ["invalid_envelope", "malformed_xml", "document_type_refused", "invalid_envelope"]
    assert "e.xml" not in rows  # Spark lists no empty files


def test_manifest_admission_and_known_files(spark, folder):
    manifest = envelopes.file_manifest(spark, folder)
    state = {r["name"]: r["rejected"] for r in envelopes.admit_files(manifest, 100).collect()}
    assert state["d.txt"] == "unsupported_extension" and state["a.xml"] == "file_too_large" and state["c.xml"] is None
    empty = spark.createDataFrame([("e.xml", 0)], "name string, size long")
    assert envelopes.admit_files(empty).first()["rejected"] == "empty_file"
    known = envelopes.skip_imported(manifest, manifest.where("name = 'c.xml'").select("sha256"))
    assert {r["name"] for r in known.where("already_imported").collect()} == {"c.xml"}


def test_parse_errors_in_order(spark):
    head = '<Provider Name="Microsoft-Windows-Sysmon"/>'
    time = '<TimeCreated SystemTime="2026-01-01T00:00:00.1234567Z"/>'
    cases = {
        None: "malformed_xml", "": "malformed_xml", "<Event>": "malformed_xml", "<!DOCTYPE x><Event/>": "document_type", "<Event><EventData/></Event>": "missing_system",
        f"<Event><System>{head}</System></Event>": "missing_event_id", f"<Event><System>{head}<EventID>x</EventID></System></Event>": "invalid_event_id",
        f"<Event><System>{head}<EventID>23</EventID></System></Event>": "invalid_timestamp", f"<Event><System>{head}<EventID>5</EventID>{time}</System></Event>": "unsupported_event",
        f"<Event><System>{head}<EventID>26</EventID>{time}</System></Event>": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw_xml string")
    got = {r.raw_xml: r for r in parse.parse_events(rows).collect()}
    assert {k: r.parse_error for k, r in got.items()} == cases
    last = list(got.values())[-1]
    assert got[list(cases)[-1]].event_ts.microsecond == 123456 and last is not None


def test_chained_lines_and_their_manifest(spark, tmp_path):
    df = spark.createDataFrame([("i", n, f"v{n}", None) for n in (2, 1, 3)], "imp string, n long, v string, w string")
    manifest = sinks.write_chained_jsonl(df, "imp", "n", str(tmp_path / "out")).first()
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/chain=i")).collect()]
    assert [x["n"] for x in lines] == [1, 2, 3] and json.loads(lines[0]["payload"]) == {"imp": "i", "n": 1, "v": "v1", "w": None}
    assert manifest.entries == 3 and manifest.status == "complete" and manifest.first_hash == lines[0]["entry_hash"] and manifest.last_hash == lines[2]["entry_hash"]
    with pytest.raises(ValueError):
        sinks.write_chained_jsonl(df.union(df), "imp", "n", str(tmp_path / "no"))


def subscriptions(spark):
    return spark.createDataFrame(
        [("c", "Microsoft-Windows-Sysmon", [1, 23, 26]), ("s", "Microsoft-Windows-Security-Auditing", [4663])], "channel string, provider string, event_ids array<int>"
    )


@pytest.fixture
def captured(spark, tmp_path):
    """The audit rows as four files of captured XML, in the order in which they were received."""
    rows = adapter.audit_rows(spark, SF)
    out = rows.select(
        "live_session_id", "received_sequence", "raw_event_id", "occurred_ts", F.when(F.col("outcome") == "security_evidence", "s").otherwise("c").alias("channel_name"),
        F.concat_ws(":", "live_session_id", F.col("received_sequence").cast("string")).alias("live_evidence_id"), parse.event_xml(F.col("outcome")).alias("raw_xml"),
    )
    path = str(tmp_path / "live")
    for k in range(4):
        out.where(F.floor((F.col("received_sequence") - 1) / 250) == k).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path).schema


def finish(query):
    query.processAllAvailable()
    query.stop()


def test_stream_is_classified_counted_stored_and_completed(spark, captured, tmp_path):
    path, schema = captured
    stream = capture.classify_stream(capture.read_live(spark, path, schema), subscriptions(spark))
    assert stream.isStreaming
    finish(capture.capture_counters(stream).writeStream.outputMode("complete").format("memory").queryName("counters").start())
    counters = spark.table("counters").collect()
    want = {r.live_session_id: r for r in adapter.audit_rows(spark, SF).groupBy("live_session_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "delete_fact").alias("d")).collect()}
    assert {r.live_session_id: (r.received, r.delete_fact) for r in counters} == {k: (r.n, r.d) for k, r in want.items()}
    assert all(r.received == sum(r[o] for o in capture.OUTCOMES) + r.dropped for r in counters)
    store = str(tmp_path / "store")
    capture.live_append_sink(stream.select("live_session_id", "received_sequence", "live_evidence_id", "outcome", "raw_xml", F.sha2("raw_xml", 256).alias("raw_xml_sha256")), store, str(tmp_path / "cp")).awaitTermination(120)
    stored = spark.read.parquet(store)
    assert stored.count() == sum(r.n for r in want.values())
    done = capture.complete_sessions(stored)
    assert {r.live_session_id: r.persisted for r in done.collect()} == {k: r.n for k, r in want.items()}
    assert capture.complete_sessions(stored, done).count() == 0
    again = spark.createDataFrame(stored.where("batch_id = 1").drop("batch_id").toPandas())
    capture.append_batch(again, store, 1)  # a repeated batch replaces itself
    assert spark.read.parquet(store).count() == sum(r.n for r in want.values())
    wrong = again.withColumn("raw_xml_sha256", F.lit("0" * 64))
    for bad, n in ((again, 9), (again.union(again), 1), (wrong, 1)):
        with pytest.raises(ValueError):
            capture.append_batch(bad, store, n)


def test_oversized_mismatching_and_late(spark):
    rows = spark.createDataFrame([("a", "c", "x" * (capture.MAX_UNITS + 1)), ("a", "zz", "<Event/>"), ("a", "c", None)], "live_session_id string, channel_name string, raw_xml string")
    out = [r.error_code for r in capture.classify_stream(rows, subscriptions(spark)).collect()]
    assert sorted(out) == ["live_event_xml_too_large", "parse_malformedxml", "parse_missingsystem"]
    sub = ("c", "p", [23])
    cases = [("p", "c", 23, "P", sub), ("q", "c", 23, None, sub), ("p", "d", 23, None, sub), ("p", None, 23, "q", sub), ("p", "c", 1, None, sub), ("p", "c", 1, None, None)]
    s = spark.createDataFrame(cases, "p string, c string, i int, r string, subscription struct<channel: string, provider: string, event_ids: array<int>>")
    found = [r[0] for r in s.select(capture.source_mismatch(F.col("p"), F.col("c"), F.col("i"), F.col("r"))).collect()]
    assert found == [None, "event_not_accepted", "channel_mismatch", "provider_mismatch", "event_not_accepted", "unknown_subscription"]


def test_late_records_are_not_stored(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "a:1", False), ("a", 2, "a:2", True)], "live_session_id string, received_sequence long, live_evidence_id string, late boolean")
    capture.append_batch(rows, str(tmp_path / "s"), 0)
    assert [r.received_sequence for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [1]


def test_redelivered_records_are_dropped(spark, captured):
    path, schema = captured
    stream = capture.read_live(spark, path, schema)
    finish(capture.dedupe_stream(stream.union(stream), delay="100 days").select("live_evidence_id").writeStream.format("memory").queryName("once").start())
    assert spark.table("once").count() == spark.read.parquet(path).count()


def test_stream_sessions_equal_the_batch_fold(spark, tmp_path):
    rows = adapter.deletes(spark, SF)
    path = str(tmp_path / "d")
    rows.coalesce(1).sortWithinPartitions("received_sequence").write.parquet(path)
    stream = capture.read_live(spark, path, spark.read.parquet(path).schema)
    finish(capture.stream_sessions(stream, adapter.RULES, adapter.RISK).writeStream.outputMode("append").format("memory").queryName("folded").start())
    got = {r.raw_event_id: (r.session_no, r["count"]) for r in spark.table("folded").collect()}
    want = {r.raw_event_id: (r.fold_session, r.fold_count) for r in sessions.sessionize_received(rows, adapter.RULES, adapter.RISK).collect()}
    assert got == want


def test_streams_correlate_like_a_batch(spark, tmp_path):
    rows = adapter.audit_rows(spark, SF)
    path = str(tmp_path / "r")
    for i in range(3):  # by time, as they would arrive
        rows.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(path)
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    stream = capture.read_live(spark, path, rows.schema)
    capture.stream_correlate(stream, store, out, str(tmp_path / "cp"), adapter.CORRELATION).awaitTermination(300)
    assert spark.read.parquet(out).count() > 0
    capture.correlate_batch(rows.limit(0), 99, store, out, adapter.CORRELATION, last=True)
    found = spark.read.parquet(out).select("raw_event_id", "method", "process_raw_id", "security_raw_id").collect()
    want = correlate.correlate(adapter.deletes(spark, SF), adapter.contexts(spark, SF), adapter.evidence(spark, SF), adapter.CORRELATION)
    every = {r.raw_event_id: r for r in want.select("raw_event_id", "method", "process_raw_id", "security_raw_id").collect()}
    assert len(found) == len(every) and {r.raw_event_id for r in found} == set(every)
    late = [r for r in found if r != every[r.raw_event_id]]
    assert len(late) < len(found) / 2  # partners that came a batch later are not seen


def test_streamed_matches_equal_the_batch_when_all_is_stored(spark, tmp_path):
    rows, store, out = adapter.audit_rows(spark, SF), str(tmp_path / "store"), str(tmp_path / "out")
    for n in (0, 0, 1):  # a repeated batch changes nothing
        capture.correlate_batch(rows if n == 0 else rows.limit(0), n, store, out, adapter.CORRELATION, last=n == 1)
    found = spark.read.parquet(out).select("raw_event_id", "method", "process_raw_id", "security_raw_id").collect()
    want = correlate.correlate(adapter.deletes(spark, SF), adapter.contexts(spark, SF), adapter.evidence(spark, SF), adapter.CORRELATION)
    assert sorted(map(repr, found)) == sorted(map(repr, want.select("raw_event_id", "method", "process_raw_id", "security_raw_id").collect()))


def test_correlation_to_the_end_equals_the_batch_without_reading_the_store(spark, tmp_path, monkeypatch):
    rows = adapter.audit_rows(spark, SF).cache()
    us = micros("occurred_ts")
    ordered = sorted(r.us for r in rows.select(us.alias("us")).collect())
    columns = ("raw_event_id", "method", "process_raw_id", "security_raw_id", "reasons")
    all_of = lambda df: sorted(map(repr, df.select(*columns).collect()))
    of = lambda outcome, df=rows: df.where(F.col("outcome") == outcome)
    match = lambda due, seen: correlate.correlate(due.drop("command_line"), of("process_context", seen), of("security_evidence", seen), adapter.CORRELATION)
    whole = {r.raw_event_id: r for r in match(of("delete_fact"), rows).select(*columns).collect()}
    reach = adapter.CORRELATION.window_us + capture.GRACE_US
    read = type(spark.read).parquet
    for cuts in ((0.2, 0.21, 0.9), (0.999,)):
        root = tmp_path / str(len(list(tmp_path.iterdir())))
        path, store, out = str(root / "r"), str(root / "store"), str(root / "out")
        bounds = [ordered[0] - 1, *(ordered[int(c * len(ordered))] for c in cuts), ordered[-1]]
        for low, high in zip(bounds, bounds[1:]):
            rows.where((us > low) & (us <= high)).coalesce(1).write.mode("append").parquet(path)
        # each delete meets all rows up to the batch at which it is due
        ends = [bounds[0] - 1, *(b - reach for b in bounds[1:-1]), bounds[-1] + 1]
        want = sorted(x for low, high, seen in zip(ends, ends[1:], bounds[1:]) for x in all_of(match(of("delete_fact").where((us >= low) & (us < high)), rows.where(us <= seen))))
        folders = []
        monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, **k: (folders.extend(p), read(self, *p, **k))[1])
        found = capture.correlate_to_end(capture.read_live(spark, path, rows.schema), store, out, str(root / "cp"), adapter.CORRELATION)
        monkeypatch.undo()
        assert store not in folders and all_of(found) == want and len(want) == len(whole)
        # against the whole table only a GUID's process that comes after the delete is due may be missed
        later = [r for r in found.select(*columns).collect() if r != whole[r.raw_event_id]]
        assert all(whole[r.raw_event_id].method == "process_guid" for r in later)
        capture.flush_correlation(spark, store, out, adapter.CORRELATION)  # once more changes nothing
        assert all_of(spark.read.parquet(out)) == want
        left = spark.read.parquet(f"{out}_open")
        newest = left.where(f"batch_id = {len(cuts)}")
        assert newest.where("outcome = 'delete_fact'").count() == 0 and newest.count() < rows.count()


def test_late_deletes_meet_partners_from_the_store(spark, tmp_path):
    rows, store, out = adapter.audit_rows(spark, SF), str(tmp_path / "store"), str(tmp_path / "out")
    late = rows.where("outcome = 'delete_fact' AND event_id % 7 = 0")
    capture.correlate_batch(rows.join(late.select("raw_event_id"), "raw_event_id", "left_anti").select(*rows.columns), 0, store, out, adapter.CORRELATION)
    capture.correlate_batch(late, 4, store, out, adapter.CORRELATION, last=True)
    found = spark.read.parquet(out).select("raw_event_id", "method", "process_raw_id", "security_raw_id").collect()
    want = correlate.correlate(adapter.deletes(spark, SF), adapter.contexts(spark, SF), adapter.evidence(spark, SF), adapter.CORRELATION)
    assert sorted(map(repr, found)) == sorted(map(repr, want.select("raw_event_id", "method", "process_raw_id", "security_raw_id").collect()))


def test_mart_written_again_replaces_its_import(spark, tmp_path):
    rows = adapter.audit_rows(spark, SF).where("event_id < 60")
    deletes, processes = rows.where("outcome = 'delete_fact'").drop("command_line"), rows.where("outcome = 'process_context'")
    found = correlate.correlate(deletes, processes, rows.where("outcome = 'security_evidence'"), adapter.CORRELATION)
    assessed = sessions.assess_risk(sessions.sessionize(deletes, adapter.RULES, adapter.RISK), adapter.RISK)
    tables = mart.build_audit_mart(rows, deletes, processes, found, assessed)
    for name in ("a", "a", "b"):
        sinks.write_audit_mart(tables, str(tmp_path), name)
    stored = {t: publication.published(spark, str(tmp_path), t) for t in tables}
    assert len(stored) == 10 and all(df.count() == 2 * tables[t].count() > 0 for t, df in stored.items())
    assert {r["import"] for r in stored["delete_events"].select("import").distinct().collect()} == {"a", "b"}


def test_a_failed_publication_shows_nothing(spark, tmp_path):
    root, one, two = str(tmp_path / "mart"), spark.range(3), spark.range(5)
    assert publication.published(spark, root, "a") is None
    broken = spark.range(4).withColumn("x", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        publication.publish(spark, root, {"a": one, "b": broken}, "k")
    assert publication.published(spark, root, "a") is None
    publication.publish(spark, root, {"a": one, "b": two}, "k")
    publication.publish(spark, root, {"a": two}, "l")
    with pytest.raises(Exception, match="broken"):
        publication.publish(spark, root, {"a": two, "b": broken}, "k")
    assert publication.published(spark, root, "a").count() == 8 and publication.published(spark, root, "b").count() == 5
    publication.publish(spark, root, {"a": spark.range(1), "b": one.limit(0)}, "k")  # all tables of a key are replaced at once
    assert publication.published(spark, root, "a").count() == 6 and publication.published(spark, root, "b").count() == 0


def test_projection_is_published_with_its_runs_and_goes_on(spark, tmp_path):
    records = adapter.captures(spark, SF).where("session_no < 3")
    totals = records.groupBy("live_session_id").agg(F.count("*").alias("persisted"))
    root = str(tmp_path / "projection")
    first = publication.publish_projection(spark, root, records.where("session_no < 2"), totals.where("live_session_id <> 'cap-1'"))
    assert {r.live_session_id: (r.refusal, r.appended > 0) for r in first.collect()} == {"cap-0": (None, True), "cap-1": ("incomplete_capture", False)}
    again = publication.publish_projection(spark, root, records, totals)
    assert {r.live_session_id: r.appended > 0 for r in again.collect()} == {"cap-0": False, "cap-1": True, "cap-2": True}
    rows, runs = publication.published(spark, root, "rows"), publication.published(spark, root, "runs")
    whole = projection.chained(projection.canonical_rows(records).drop("failure"))
    assert sorted(map(str, rows.select("live_evidence_id", "entry_hash").collect())) == sorted(map(str, whole.select("live_evidence_id", "entry_hash").collect()))
    epochs = projection.channel_epochs(rows).drop("records")
    assert {r.reason for r in projection.verify_continuity(rows, records, epochs, runs).collect()} == {None}


def test_sequences_rise_from_batch_to_batch(spark, tmp_path):
    store = str(tmp_path / "store")
    batch = lambda *numbers: spark.createDataFrame([(s, n, f"{s}:{n}") for s, n in numbers], "live_session_id string, received_sequence long, live_evidence_id string")
    capture.append_batch(batch(("a", 2), ("a", 5), ("b", 1)), store, 0)
    capture.append_batch(batch(("a", 7), ("c", 1)), store, 1)
    for late in (("a", 6), ("a", 3), ("b", 1)):  # numbers that nothing stored has are refused as well
        with pytest.raises(ValueError):
            capture.append_batch(batch(late, ("d", 1)), store, 2)
    capture.append_batch(batch(("a", 7), ("c", 1)), store, 1)
    capture.append_batch(batch(("a", 8), ("b", 2)), store, 2)
    assert sorted(map(tuple, spark.read.parquet(store).select("live_session_id", "received_sequence").collect())) == [("a", 2), ("a", 5), ("a", 7), ("a", 8), ("b", 1), ("b", 2), ("c", 1)]
