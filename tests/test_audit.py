"""Audit rules against plain Python, boundary cases, and all queries against their SQL."""

import datetime as dt
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators import correlate as K
from ledgerloom.operators import analysis, integrity, ordering, projection, quality, sessions, views
from ledgerloom.options import HOUR, SECOND, CorrelationOptions, ProtectedRule, RiskOptions
from ledgerloom.plans import adapter, audit_queries
from ledgerloom.plans.scratch import written

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 1, 1)
EVENT = (
    "raw_event_id string, record_ordinal long, import_session_id string, live_session_id string, received_sequence long, occurred_ts timestamp_ntz, computer_name string, "
    "process_id int, process_guid string, process_path string, user_name string, user_sid string, full_path string, delete_permission string, command_line string"
)


def event(i, us, **own):
    row = {
        "raw_event_id": f"r{i}", "record_ordinal": i, "import_session_id": "imp", "live_session_id": "live", "received_sequence": i, "occurred_ts": T0 + dt.timedelta(microseconds=us),
        "computer_name": "PC", "process_id": 1, "process_guid": "{g}", "process_path": "C:\\p.exe", "user_name": "u", "user_sid": None, "full_path": "C:\\Lab\\x\\f.txt",
        "delete_permission": "not_observed", "command_line": None,
    }
    return tuple((row | own).values())


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


@pytest.mark.parametrize(("n", "risk"), [(29, "informational"), (30, "warning"), (99, "warning"), (100, "critical")])
def test_counts_grade_sessions(spark, n, risk):
    rows = frame(spark, [event(i, i * 1000) for i in range(n)])
    out = sessions.session_summary(sessions.assess_risk(sessions.sessionize(rows))).collect()
    assert [(r.items, r.max_risk) for r in out] == [(n, risk)]


def test_gap_of_the_window_stays_inside_and_a_longer_one_opens(spark):
    rows = frame(spark, [event(0, 0), event(1, 10 * SECOND), event(2, 20 * SECOND + 1)])
    out = {r.raw_event_id: r.session_no for r in sessions.sessionize(rows).collect()}
    assert out == {"r0": 1, "r1": 1, "r2": 2}


def test_protected_path_is_critical_at_once(spark):
    rules = [ProtectedRule("off", "C:\\", False), ProtectedRule("on", "c:/lab/X/")]
    out = sessions.assess_risk(sessions.sessionize(frame(spark, [event(0, 0)]), rules)).first()
    assert (out.risk, out.rule_code, out.scope) == ("critical", "protected_root", "c:/lab/X/")


def ladder(d, ps, window):
    """The rules of correlation by a plain walk over all processes."""
    near = lambda xs: min(xs, key=lambda p: (abs(d["us"] - p["us"]), p["n"]))["id"] if xs else None
    if d["guid"]:
        if hit := near([p for p in ps if p["guid"] == d["guid"]]):
            return "process_guid", hit
    reused = lambda p: any(o["pid"] == p["pid"] and p["us"] < o["us"] <= d["us"] for o in ps)
    if hit := near([p for p in ps if p["pid"] == d["pid"] and p["user"] == d["user"] and abs(d["us"] - p["us"]) <= window and not reused(p)]):
        return "device_pid_user_and_time", hit
    if hit := near([p for p in ps if p["path"] == d["path"] and abs(d["us"] - p["us"]) <= window]):
        return "path_and_time_heuristic", hit
    return "none", None


def test_correlation_equals_a_plain_walk(spark):
    r = random.Random(5)
    make = lambda k, n: [
        {"id": f"{k}{i}", "n": i, "us": r.randrange(60), "pid": r.randrange(4), "guid": r.choice([None, None, "{a}", "{b}"]), "user": r.choice("uv"), "path": r.choice(["C:\\p", "C:\\q"])} for i in range(n)
    ]
    ds, ps = make("d", 80), make("p", 25)
    ps = [p | {"guid": p["guid"] or f"{{{p['id']}}}"} for p in ps]
    to = lambda xs: frame(spark, [event(x["n"], x["us"] * SECOND, raw_event_id=x["id"], process_id=x["pid"], process_guid=x["guid"], user_name=x["user"], process_path=x["path"]) for x in xs])
    out = K.correlate(to(ds).drop("command_line"), to(ps), frame(spark, []), CorrelationOptions(5 * SECOND)).collect()
    got = {x.raw_event_id: (x.method, x.process_raw_id) for x in out}
    assert got == {d["id"]: ladder(d, ps, 5) for d in ds}


def test_windowed_matches_need_no_nested_loop(spark):
    d, p = frame(spark, [event(0, 0)]), frame(spark, [event(1, 0)])
    o = CorrelationOptions()
    for df in (K.match_process_pid(d, p, o), K.match_process_path(d, p, o), K.match_security(d, p, o)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_matches_on_a_hot_key_equal_a_plain_walk_without_pairs(spark):
    r = random.Random(9)
    hours = lambda hot: r.randrange(12) * 3_600 + r.randrange(8) if hot else r.randrange(40 * 3_600)
    make = lambda k, n: [
        {
            "id": f"{k}{i}", "n": i, "us": hours(i % 2 == 0) * SECOND, "pc": "HOT" if i % 2 == 0 else r.choice(["a", "b", None]), "pid": r.choice([1, 1, 2, None]), "user": r.choice(["u", "V", " ", None]),
            "sid": r.choice(["s1", "S2", "", None]), "path": r.choice(["C:\\p", "c:/P", "C:\\q", None]), "guid": r.choice(["{a}", None, None]),
        }
        for i in range(n)
    ]
    ds, ps = make("d", 600), make("p", 600)
    to = lambda xs: frame(spark, [event(x["n"], x["us"], raw_event_id=x["id"], computer_name=x["pc"], process_id=x["pid"], user_name=x["user"], user_sid=x["sid"], process_guid=x["guid"], process_path=x["path"], full_path=x["path"], delete_permission="delete_requested") for x in xs])
    low = lambda v: v.lower().replace("/", "\\") if v and v.strip() else None
    same = lambda a, b: a is not None and a == b
    user = lambda d, p: low(d["sid"]) == low(p["sid"]) if low(d["sid"]) and low(p["sid"]) else same(low(d["user"]), low(p["user"]))
    reused = lambda p, d: any(same(o["pc"], p["pc"]) and o["pid"] == p["pid"] and p["us"] < o["us"] <= d["us"] for o in ps)
    near = lambda d, xs: min(((abs(d["us"] - p["us"]), p["n"], p["id"]) for p in xs), default=(None, None, None))[2]
    window = 3 * SECOND
    within = lambda d: [p for p in ps if same(d["pc"], p["pc"]) and abs(d["us"] - p["us"]) <= window]
    want = {"guid": {}, "pid": {}, "path": {}, "reliable": {}, "hint": {}}
    for d in ds:
        close = within(d)
        on_path = [p for p in close if same(low(d["path"]), low(p["path"]))]
        want["guid"][d["id"]] = near(d, [p for p in ps if same(d["pc"], p["pc"]) and same(d["guid"], p["guid"])])
        want["pid"][d["id"]] = near(d, [p for p in close if same(d["pid"], p["pid"]) and user(d, p) and not reused(p, d)])
        want["path"][d["id"]] = want["hint"][d["id"]] = near(d, on_path)
        want["reliable"][d["id"]] = near(d, [p for p in on_path if same(d["pid"], p["pid"]) and user(d, p)])
    o, d, p = CorrelationOptions(window), to(ds), to(ps)
    security = K.match_security(d, p, o)
    frames = {"guid": (K.match_process_guid(d, p), "by_guid"), "pid": (K.match_process_pid(d, p, o), "by_pid"), "path": (K.match_process_path(d, p, o), "by_path"), "reliable": (security, "reliable"), "hint": (security, "hint")}
    for name, (df, column) in frames.items():
        got = {x.d_id: x.id for x in df.select("d_id", F.col(f"{column}.id").alias("id")).collect() if x.id is not None}
        assert got == {k: v for k, v in want[name].items() if v is not None}, name
        assert len(got) > 20


def test_half_of_all_rows_on_one_computer_are_many_even_tasks(spark):
    rows = lambda k: spark.range(20_000).select(
        F.concat(F.lit(k), "id").alias("raw_event_id"), F.col("id").alias("record_ordinal"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 97) % 500_000)).alias("occurred_ts"),
        F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("pc"), F.col("id") % 500)).alias("computer_name"), F.lit(1).alias("process_id"), F.lit("C:\\p").alias("process_path"), F.lit("u").alias("user_name"), F.lit(None).cast("string").alias("user_sid"),
    )
    d, p = (K._side(rows(k), k) for k in "dp")
    cut = K._keyed(d, "d", (2, 1), False).select("computer", "tier", "text", "pid", "user", "d_us").withColumn("bucket", F.floor(F.col("d_us") / HOUR))
    tasks = cut.repartition(32, "computer", "tier", "text", "pid", "user", "bucket").groupBy(F.spark_partition_id().alias("t")).count().collect()
    sizes = sorted(x["count"] for x in tasks)
    assert len(sizes) == 32 and sizes[-1] < 2 * sizes[16]
    plan = K.process_candidates(d, p, 3 * SECOND)._jdf.queryExecution().optimizedPlan().toString()
    assert "d_us" in plan and not [x for x in plan.splitlines() if "Join" in x and "p_us" in x and "d_us" in x]  # sides meet by sorting only
    assert K.process_candidates(d, p, 3 * SECOND).groupBy("d_id", "tier").count().where("count > 3").count() == 0


def test_received_order_fold_equals_a_plain_walk(spark):
    r = random.Random(3)
    rows = [event(i, r.randrange(80) * SECOND, raw_event_id=f"r{r.randrange(35)}") for i in range(40)]
    out = sessions.sessionize_received(frame(spark, rows)).orderBy("received_sequence").collect()
    walked, got = [], [(x.fold_session, x.fold_count) for x in out]
    want = []
    for x in rows:
        us = int((x[5] - T0).total_seconds() * SECOND)
        near = [s for s in walked if abs(us - s["last"]) <= 10 * SECOND and us >= s["opened"] - 10 * SECOND]
        if near:
            s = sorted(near, key=lambda s: -s["last"])[0]
        else:
            s = {"no": len(walked), "opened": us, "last": us, "ids": set()}
            walked.append(s)
        if x[0] not in s["ids"]:
            s["ids"].add(x[0])
            s["last"] = max(s["last"], us)
        want.append((s["no"], len(s["ids"])))
    assert got == want


def test_capture_analysis_equals_a_plain_walk(spark):
    r = random.Random(8)
    rows = [event(i, r.randrange(200) * SECOND, full_path=f"C:\\Lab\\{r.choice('ab')}\\f.txt") + (r.choice(["delete_fact", "delete_fact", "error"]),) for i in range(60)]
    rules, risk = (ProtectedRule("p", "C:\\Lab\\b"),), RiskOptions(warning=2, critical=4)
    df = spark.createDataFrame(rows, EVENT + ", outcome string")
    matched, found, counters = analysis.analyze_session(df, "live", rules, risk=risk, limit=30)
    walked, last = [], {}
    for x in [x for x in rows if x[-1] == "delete_fact"][:30]:
        us, scope, protected = int((x[5] - T0).total_seconds() * SECOND), x[12].rsplit("\\", 1)[0], "\\b" in x[12]
        near = [s for s in walked if s["scope"] == scope and abs(us - s["last"]) <= 10 * SECOND and us >= s["opened"] - 10 * SECOND]
        if near:
            s = sorted(near, key=lambda s: -s["last"])[0]
        else:
            s = {"no": len(walked) + 1, "scope": scope, "opened": us, "last": us, "items": 0, "risk": 0}
            walked.append(s)
        s["items"] += 1
        s["last"] = max(s["last"], us)
        own = 2 if protected or s["items"] >= 4 else 1 if s["items"] >= 2 else 0
        s["risk"], last[s["no"]] = max(s["risk"], own), ["single_delete", "burst_2_in_window", "burst_4_in_window"][own] if not protected else "protected_root"
    got = {x.ordinal: (x.scope, x["items"], x.max_risk, x.rule_code) for x in found.collect()}
    assert got == {s["no"]: (s["scope"], s["items"], sessions.RISKS[s["risk"]], last[s["no"]]) for s in walked}
    c = counters.first()
    assert (c.records, c.deletes, c.truncated, c.uncorrelated, c.unparsable) == (30, 30, True, 30, sum(x[-1] == "error" for x in rows)) and matched.count() == 30


def test_chain_detects_each_kind_of_change(spark):
    df = spark.createDataFrame([("c", i, f"p{i}") for i in range(1, 6)], "chain string, n long, payload string")
    chained = integrity.build_chain(df, "chain", "n", F.col("payload")).join(df, ["chain", "n"])
    check = lambda x: tuple(integrity.verify_chain(x, F.col("payload")).first())
    assert check(chained) == ("c", 5, None, None)
    at3 = lambda c, v: chained.withColumn(c, F.when(F.col("n") == 3, v).otherwise(F.col(c)))
    assert check(at3("payload", "x"))[2:] == (3, "content_hash_mismatch")
    assert check(at3("entry_hash", "0" * 64))[2:] == (3, "entry_hash_mismatch")
    assert check(at3("previous_hash", "zz"))[2:] == (3, "invalid_hash_encoding")
    assert check(at3("previous_hash", None))[2:] == (3, "missing_or_invalid_chain_field")
    assert check(at3("version", "2"))[2:] == (3, "unsupported_version")
    assert check(chained.where("n <> 3"))[2:] == (4, "previous_hash_mismatch")


def test_chains_go_on_from_a_stored_tail(spark):
    rows = [("a", i, f"p{i}") for i in range(1, 9)] + [("b", i, f"q{i}") for i in range(1, 4)]
    df = spark.createDataFrame(rows, "chain string, n long, payload string")
    build = lambda x, tails=None: {(r.chain, r.n): r.entry_hash for r in integrity.build_chain(x, "chain", "n", F.col("payload"), tails=tails).collect()}
    whole = build(df)
    tails = spark.createDataFrame([("a", whole["a", 5])], "chain string, entry_hash string")
    assert build(df.where("chain = 'b' OR n > 5"), tails) == {k: v for k, v in whole.items() if k[0] == "b" or k[1] > 5}


def test_tails_meet_their_chains_where_both_sides_lie_by_the_chain(spark):
    merge = "spark.sql.adaptive.coalescePartitions"
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", f"{merge}.minPartitionSize": "16k", f"{merge}.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        chain = lambda n: F.concat(F.lit("c"), (F.col("id") % n).cast("string")).alias("chain")
        rows = spark.range(20_000).select(chain(400), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
        accepted = spark.range(400).select(chain(400)).groupBy("chain").agg(F.count("*").alias("k"))
        tails = spark.range(800).select(chain(400), "id").groupBy("chain").agg(F.max_by(F.concat(F.lit("t-"), "chain"), "id").alias("entry_hash"))
        # the join and the aggregation deal their rows out by the chain, and partitions are merged on either side by its own sizes
        folded = integrity.fold_hashes(rows.join(accepted, "chain").drop("k"), "chain", "n", ["content_hash"], lambda previous, own: f"{previous[:6]}|", tails)
        firsts = folded.groupBy("chain").agg(F.min_by("previous_hash", "n").alias("first"), F.count("*").alias("n")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.chain: (r.first, r.n) for r in firsts} == {f"c{i}": (f"t-c{i}", 50) for i in range(400)}


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_orders_cut_into_buckets_equal_plain_windows(spark, size):
    r = random.Random(size)
    rows = [(r.choice([None, "x", "y"]), n, r.randrange(9)) for n in r.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k string, n long, v long")
    want = {}
    for k in (None, "x", "y"):
        own = sorted((n, v) for c, n, v in rows if c == k)
        for i, (n, _) in enumerate(own):
            want[n] = (i + 1, own[i + 1][0] if i + 1 < len(own) else None, own[i - 1][1] if i else None)
    out = ordering.before(ordering.following(ordering.numbered(df, ["k"], "n", "no", size), ["k"], "n", "next", size), ["k"], "n", "v", "was", size).collect()
    assert {x.n: (x.no, x.next, x.was) for x in out} == want


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_nearest_on_both_sides(spark, size):
    r = random.Random(size)
    left = [(i, r.choice("xy"), r.randrange(40)) for i in range(50)] + [(99, None, 3)]
    right = [(i, r.choice("xy"), r.randrange(40)) for i in range(15)] + [(77, None, 3)]
    out = ordering.nearest(spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(right, "j long, k string, u long"), ["k"], ("t", "u"), F.struct("j", "u"), "j", size)
    got = {x.i: (x.before and tuple(x.before), x.after and tuple(x.after)) for x in out.collect()}
    pick = lambda xs, near: (lambda b: (b[0], b[2]) if b else None)(min(xs, key=lambda x: (abs(x[2] - near), x[0]), default=None))
    assert got == {i: (pick([x for x in right if k and x[1] == k and x[2] <= t], t), pick([x for x in right if k and x[1] == k and x[2] >= t], t)) for i, k, t in left}


@pytest.mark.parametrize("size", [1, 4, 30, 10_000])
def test_segments_over_buckets_equal_a_walk(spark, size):
    r = random.Random(size)
    rows = [(r.choice(["hot", "hot", "hot", None, "x"]), r.choice([None, *range(300)]), i) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    want = {}
    for k in ("hot", None, "x"):
        no, n, first, before = 0, 0, None, None
        for t, i in sorted(((t, i) for c, t, i in rows if c == k), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
            if before is None or t is None or t - before > 5:
                no, n, first = no + 1, 0, i
            n, before = n + 1, t
            want[i] = (no, n, first)
    out = ordering.segmented(df, ["k"], "t", "i", 5, F.struct("i"), size).collect()
    assert {x.i: (x.segment_no, x.running_count, x.opened.i) for x in out} == want


def test_a_hot_key_is_cut_into_many_buckets(spark):
    rows = frame(spark, [event(i, i * 40 * SECOND + (i % 3) * SECOND) for i in range(300)])
    bucket = 240 * SECOND
    found = sessions.sessionize(rows, options=RiskOptions(45 * SECOND), bucket_us=bucket)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "Window [" in line and "row_number" in line]
    assert scans and all("_bucket" in line for line in scans)  # the rows themselves are never in order of the bare key
    whole = sessions.sessionize(rows, options=RiskOptions(45 * SECOND), bucket_us=10**12)
    columns = ["raw_event_id", "session_no", "running_count", "opened_us", "session_id"]
    assert sorted(found.select(*columns).collect()) == sorted(whole.select(*columns).collect())
    assert rows.select(F.floor(C.micros("occurred_ts") / bucket)).distinct().count() >= 50 and found.agg(F.max("running_count")).first()[0] == 300


def test_received_sessions_fold_apart_across_gaps(spark):
    r = random.Random(12)
    rows = [event(i, r.choice([0, 1000, 2000, 90_000]) * SECOND + r.randrange(40) * SECOND, raw_event_id=f"r{r.randrange(100)}") for i in range(120)]
    out = sessions.sessionize_received(frame(spark, rows)).orderBy("received_sequence").collect()
    fold, want = sessions.ReceivedFold(10 * SECOND), []
    for x in rows:
        want.append(fold.add(int((x[5] - T0).total_seconds() * SECOND), x[0])[:2])
    assert [(x.fold_session, x.fold_count) for x in out] == want and fold.next_no > 4


@pytest.mark.parametrize(("keep", "reach"), [(1, 5), (2, 7), (3, 100), (50, 9)])
def test_nearest_k_equals_all_pairs(spark, keep, reach):
    r = random.Random(keep)
    left = [(i, r.choice([None, *range(120)])) for i in range(60)]
    right = [(j, r.choice([None, *range(0, 120, 3)])) for j in range(50)]
    r.shuffle(right)
    d, o = spark.createDataFrame(left, "i long, t long"), spark.createDataFrame(right, "j long, u long")
    found = ordering.nearest_k(d, o, ("t", "u"), "j", keep, reach)
    assert "BroadcastNestedLoop" not in found._jdf.queryExecution().toString()
    pairs = found.collect()
    assert len({(x.i, x.j) for x in pairs}) == len(pairs) <= len(left) * 2 * keep
    for i, t in left:
        near = sorted((abs(t - u), j) for j, u in right if t is not None and u is not None and abs(t - u) <= reach)[:keep]
        assert sorted((x.delta, x.j) for x in pairs if x.i == i)[:keep] == near


def test_payload_hash_tells_null_from_empty(spark):
    row = spark.range(1).select(*(integrity.payload_hash([F.lit(v).cast("string"), F.lit("a")]) for v in (None, "", "x"))).first()
    assert len(set(row)) == 3


def _stored_projection(spark):
    records = adapter.captures(spark, SF).where("session_no < 2")
    rows = written(projection.chained(projection.canonical_rows(records).drop("failure")), "projected")
    return written(records, "records"), rows, projection.channel_epochs(rows).drop("records")


def test_continuity_finds_each_kind_of_change(spark):
    records, rows, epochs = _stored_projection(spark)
    n = {r.live_session_id: r["count"] for r in rows.groupBy("live_session_id").count().collect()}
    runs = spark.createDataFrame([(s, True, c) for s, c in n.items()], "live_session_id string, completed boolean, considered long")
    mine = F.col("live_session_id") == "cap-0"
    third = rows.where(mine & (F.col("projected_sequence") == 3)).first()
    here = F.col("live_evidence_id") == third.live_evidence_id
    check = lambda rows=rows, records=records, epochs=epochs: {r.live_session_id: r[1:] for r in projection.verify_continuity(rows, records, epochs, runs).collect()}
    at3 = lambda c, v: rows.withColumn(c, F.when(here, v).otherwise(F.col(c)))
    source = lambda c, v: records.withColumn(c, F.when(here, v).otherwise(F.col(c)))
    sound = {s: (c, None, None, None) for s, c in n.items()}
    assert check() == sound
    broken = lambda reason, place=3, evidence=third.live_evidence_id: sound | {"cap-0": (place - 1, place, evidence, reason)}
    assert check(at3("received_sequence", 99)) == broken("source_identity_mismatch")
    assert check(records=records.where(~here)) == broken("missing_source")
    assert check(records=source("raw_xml_sha256", "0" * 64)) == broken("source_digest_mismatch")
    assert check(at3("projected_id", "x")) == broken("identity_mismatch") == check(at3("epoch_id", F.lit(None).cast("string")))
    for c, v in (("process_path", "x"), ("event_ts", F.col("event_ts") + F.expr("INTERVAL 1 MICROSECOND")), ("missing", F.array_union(F.array(F.lit("zz")), "missing")), ("missing", F.lit(None).cast("array<string>")), ("parser_raw_event_id", "0" * 64)):
        assert check(at3(c, v)) == broken("payload_mismatch"), c
    for c, v in (("payload_hash", F.upper("payload_hash")), ("raw_xml_sha256", "0" * 64), ("raw_xml_sha256", F.lit(None).cast("string"))):
        assert check(at3(c, v)) == broken("digest_mismatch"), c
    assert check(at3("previous_hash", F.upper("previous_hash"))) == broken("previous_hash_mismatch")
    fourth = rows.where(mine & (F.col("projected_sequence") == 4)).first().live_evidence_id
    assert check(at3("entry_hash", "0" * 64)) == broken("entry_hash_mismatch") and check(rows.where(~here)) == broken("sequence_not_dense", 3, fourth)
    own = F.col("epoch_id") == third.epoch_id
    opened = rows.where(own).orderBy("projected_sequence").first()
    of_epoch = lambda reason: broken(reason, opened.projected_sequence, opened.live_evidence_id)
    assert check(epochs=epochs.where(~own)) == of_epoch("epoch_missing")
    assert check(epochs=epochs.withColumn("channel_name", F.when(own, "zz").otherwise(F.col("channel_name")))) == of_epoch("epoch_identity_mismatch")
    for c, v in (("provider_name", "zz"), ("first_sequence", 99), ("opened_ts", F.lit(None).cast("timestamp_ntz"))):
        assert check(epochs=epochs.withColumn(c, F.when(own, v).otherwise(F.col(c)))) == of_epoch("epoch_first_record_mismatch")
    last = rows.where(mine & (F.col("projected_sequence") == n["cap-0"] - 1)).first().live_evidence_id
    assert check(rows.where(~(mine & (F.col("projected_sequence") == n["cap-0"])))) == sound | {"cap-0": (n["cap-0"] - 1, n["cap-0"], last, "tail_cut")}


def test_continuity_shuffles_digests_and_not_whole_rows(spark):
    records, rows, epochs = _stored_projection(spark)
    runs = spark.createDataFrame([("cap-0", True, 1)], "live_session_id string, completed boolean, considered long")
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan is none yet
    try:
        steps, moved = [projection.verify_continuity(rows, records, epochs, runs)._jdf.queryExecution().executedPlan()], []
        while steps:
            step = steps.pop()
            steps += listed(step.children())
            if step.nodeName() == "Exchange":
                moved.append({c.name() for c in listed(step.output())})
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(moved) > 4 and not [m for m in moved if m & {"raw_xml", "full_path", "process_path", "command_line", "missing", "payload_hash", "c_payload_hash"}]


def test_a_tidy_write_leaves_the_setting_as_it_was(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    assert written(spark.range(1000).repartition(5, "id"), "tidy", "zstd", tidy=True).count() == 1000 and spark.conf.get(setting) == before


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_numbers_with_the_value_before_equal_a_walk(spark, size):
    rnd = random.Random(5)
    rows = [(k, n, f"v{rnd.randrange(99)}" if rnd.random() < 0.8 else None) for k in ("a", "b", None) for n in rnd.sample(range(60), 25)]
    rows += [("c", 4, "y"), ("c", 4, "x"), ("c", 9, "z")]  # equal orders stand in the order of the value
    out = ordering.numbered_with_before(spark.createDataFrame(rows, "k string, n long, v string"), ["k"], "n", "no", "v", "was", size).collect()
    want = []
    for key in ("a", "b", "c", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] or ""))
        want += [(*r, i + 1, own[i - 1][2] if i else None) for i, r in enumerate(own)]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.parse_int64(F.lit("0x1092"))) == 4242 and one(C.parse_int64(F.lit("zz"))) is None and one(C.parse_pid(F.lit("-1"))) is None
    assert one(C.parent_path(F.lit("C:\\a.txt"))) == "C:\\a.txt" and one(C.parent_path(F.lit(" "))) is None
    pairs = F.array(*(F.struct(F.lit(n).cast("string").alias("name"), F.lit(v).alias("value")) for n, v in (("A", "1"), ("a", "2"), (None, "3"), (" ", "4"), ("b", "5"))))
    assert one(C.event_data_map(pairs)) == {"a": "1", "b": "5"}
    assert one(C.contains_ci(F.lit("100%_a"), "%_A")) and not one(C.contains_ci(F.lit("100"), "%"))
    assert one(C.path_kind(F.lit("\\\\?\\UNC\\s\\x"))) == "device_namespace"


def test_options_refuse_nonsense():
    for bad in (lambda: RiskOptions(warning=5, critical=5), lambda: CorrelationOptions(0), lambda: views.EventQuery(risk="x"), lambda: C.time_range(F.lit(1), "b", "a")):
        with pytest.raises((ValueError, AssertionError)):
            bad()


def test_contract_counts_violations(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    out = {r.rule: r.violations for r in quality.check_contract(df, {"v is a": F.col("v") == "a"}, ["k"]).collect()}
    assert out == {"v is a": 2, "unique k": 1}


def _plain(v):
    return tuple(_plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("events", "pages", "documents"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", list(audit_queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    result = duck.execute(audit_queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = sorted((_plain(r) for r in result.fetchall()), key=repr)
    df = audit_queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((_plain(tuple(r)) for r in df.select(*names).collect()), key=repr) == want
