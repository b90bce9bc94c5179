"""Streaming J4-J7 and J12: stream = batch however the files cut the events, late rows, restarts, bounded state; batch
sessions, lags and uniqueness of hot entities."""
import datetime as dt
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import contracts as C
from tidewell.operators.timeseries import bucketed_sessions, ranged_lag
from tidewell.streaming import analytics as A
from tidewell.streaming import jobs as J
from tidewell.streaming.state import interval_count, objects, packed, plain, recent_counts, stream_lag, unpacked

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "event_id long, user_id string, ts timestamp, lat double, lon double, level double"


def _rows(n=400, users=5, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        user = "hot" if r.random() < 0.5 else f"u{r.randrange(users)}"
        at = T0 + dt.timedelta(seconds=i * 37 + r.randrange(30), microseconds=r.randrange(10 ** 6))
        out.append((i, user, at, r.choice([10.0, 10.5, 48.0]), r.choice([1.0, 1.2, 99.0]), r.uniform(0, 100)))
    return out


def _files(spark, path, rows, parts, shuffled_within=0):
    """One file for each of ``parts`` runs of rows, in event-time order but for ``shuffled_within`` neighbours."""
    rows = sorted(rows, key=lambda x: x[2])
    if shuffled_within:
        r = random.Random(3)
        for a in range(0, len(rows), shuffled_within):
            part = rows[a: a + shuffled_within]
            r.shuffle(part)
            rows[a: a + shuffled_within] = part
    step = -(-len(rows) // parts)
    for a in range(0, len(rows), step):
        spark.createDataFrame(rows[a: a + step], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


LAST = (10 ** 6, "closing", T0 + dt.timedelta(days=300), 0.0, 0.0, 0.0)


def _forms():
    return {"velocity": lambda df: A.velocity(df, window_seconds=600, threshold=2, delay="30 minutes").select("event_id", "user_id", "recent"),
            "travel": lambda df: A.impossible_travel(df, "user_id", "ts", "lat", "lon", "event_id", delay="30 minutes"),
            "alerts": lambda df: A.crossing_alerts(df, "user_id", "ts", "level", "event_id", 50.0, delay="30 minutes")}


@pytest.mark.parametrize("form", ["velocity", "travel", "alerts"])
def test_stream_equals_batch_over_many_files_out_of_order(spark, tmp_path, form):
    rows = _rows()
    _files(spark, str(tmp_path / "in"), rows, 5, shuffled_within=20)
    _files(spark, str(tmp_path / "in"), [LAST], 1)
    run = _forms()[form]
    got = J.run_to_table(run(_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c"), 2)
    want = run(spark.createDataFrame(rows, SCHEMA))
    a = sorted(map(str, got.where("user_id <> 'closing'").select(*want.columns).collect()))
    assert a == sorted(map(str, want.collect())) and len(a) > 10


def test_stream_restarts_without_repeats_and_drops_late_events(spark, tmp_path):
    rows = sorted(_rows(200), key=lambda x: x[2])
    src, out, ckpt = (str(tmp_path / p) for p in ("in", "out", "c"))
    run = _forms()["alerts"]
    _files(spark, src, rows[:100], 2)
    J.run_to_table(run(_stream(spark, src)), out, ckpt, 2)
    _files(spark, src, rows[100:], 2)
    _files(spark, src, [LAST], 1)
    J.run_to_table(run(_stream(spark, src)), out, ckpt, 2)
    # far behind the watermark by now: left out
    _files(spark, src, [(777, "hot", T0, 0.0, 0.0, 99.0), (778, "hot", T0 + dt.timedelta(seconds=1), 0.0, 0.0, 1.0)], 1)
    got = J.run_to_table(run(_stream(spark, src)), out, ckpt, 2)
    want = run(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_state_of_silent_entities_is_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    early = [(i, f"u{i}", T0 + dt.timedelta(seconds=i), 0.0, 0.0, 9.0) for i in range(20)]
    late = [(50, "v", T0 + dt.timedelta(days=2), 0.0, 0.0, 9.0), (51, "u3", T0 + dt.timedelta(days=2, hours=1), 0.0, 0.0, 1.0)]
    _files(spark, src, early, 1)
    _files(spark, src, late[:1], 1)
    _files(spark, src, late[1:], 1)
    _files(spark, src, [LAST], 1)
    df = stream_lag(_stream(spark, src), "user_id", "ts", ["level"], "event_id", "10 minutes", "1 hour")
    with J.state_partitioning(spark, 2):
        q = J.to_table(df, str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p.get("stateOperators")]
    assert max(kept) >= 20 and kept[-1] <= 2
    got = {r["event_id"]: r["prev_level"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[51] is None and len(got) >= 22  # u3 was forgotten after an hour


def _plain_counts(rows, width):
    """(entity, ts, key) of every event and the events of its entity in [ts - width, ts], once for each equal event."""
    out = {}
    for k, e, t in rows:
        if t is not None:
            n = sum(f == e and u is not None and t - dt.timedelta(seconds=width) <= u <= t for _, f, u in rows)
            out[e, t, k] = out.get((e, t, k), 0) + n
    return {(e, t, k, n) for (e, t, k), n in out.items()}


@pytest.mark.parametrize("shards", [1, 50])
def test_counts_of_a_stream_by_brute_force(spark, tmp_path, shards):
    r = random.Random(shards)
    whole = [T0 + dt.timedelta(seconds=60 * i) for i in range(0, 400, 3)]  # a minute's window: ends of windows and buckets are met
    rows = [(r.choice([i, 2 ** 53 + 1 + i, None]), r.choice(["hot", "hot", "a", "b", "", None]), r.choice(whole) + dt.timedelta(microseconds=r.choice([0, 0, 1, -1]) + r.choice([0, 60]) * 10 ** 6)) for i in range(500)]
    rows += rows[:20] + [(None, None, rows[0][2]), (0, None, rows[0][2]), (7, "a", None)]
    end = (-1, "closing", T0 + dt.timedelta(days=300))
    rows.sort(key=lambda x: x[2] or T0)
    for part in (rows[:300], rows[300:], [end]):
        spark.createDataFrame(part, "k long, e string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k long, e string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = J.run_to_table(interval_count(src, "e", "ts", "k", 60, "1000 days", shards=shards), str(tmp_path / "out"), str(tmp_path / "c"), 2)
    assert got.count() == 0  # the watermark is behind all of them
    got = J.run_to_table(interval_count(src, "e", "ts", "k", 60, "10 hours", shards=shards), str(tmp_path / "out2"), str(tmp_path / "c2"), 2)
    found = [tuple(x) for x in got.select("e", "ts", "k", "recent").collect()]
    assert len(found) == len(set(found)) and set(found) == _plain_counts(rows, 60)


def test_a_busy_entity_is_counted_without_a_state_row_for_each_event(spark, tmp_path):
    rows = [(i, "hot", T0 + dt.timedelta(milliseconds=100 * i), 0.0, 0.0, 0.0) for i in range(3000)]
    _files(spark, str(tmp_path / "in"), rows, 1)
    _files(spark, str(tmp_path / "in"), [LAST], 1)
    df = A.velocity(_stream(spark, str(tmp_path / "in")), window_seconds=60, threshold=600, delay="1 minute")
    with J.state_partitioning(spark, 2):
        q = J.to_table(df, str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p.get("stateOperators")]
    assert 0 < max(kept) < 100
    assert {r["event_id"]: r["recent"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {i: 601 for i in range(600, 3000)}


def test_velocity_restarts_without_repeats_and_drops_late_events(spark, tmp_path):
    rows = sorted(_rows(200), key=lambda x: x[2])
    src, out, ckpt = (str(tmp_path / p) for p in ("in", "out", "c"))
    run = _forms()["velocity"]
    _files(spark, src, rows[:100], 2)
    J.run_to_table(run(_stream(spark, src)), out, ckpt, 2)
    _files(spark, src, rows[100:], 2)
    _files(spark, src, [LAST], 1)
    J.run_to_table(run(_stream(spark, src)), out, ckpt, 2)
    _files(spark, src, [(777 + i, "hot", rows[50][2], 0.0, 0.0, 0.0) for i in range(5)], 1)
    got = J.run_to_table(run(_stream(spark, src)), out, ckpt, 2)
    want = run(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, got.where("user_id <> 'closing'").collect())) == sorted(map(str, want.collect())) and want.count() > 5


def test_rows_of_a_state_come_back_as_they_were():
    x = pd.DataFrame({"_b": [0, 0], "_own": [True, False], "_e": ["a", None], "_d": [dt.date(2024, 1, 1), None], "_k": [2 ** 60 + 1, 3], "_f": [np.nan, 1.5], "_t": pd.to_datetime(["2024-01-01", None])})
    pd.testing.assert_frame_equal(unpacked(packed(x)), x)
    x = pd.DataFrame({"_b": [0] * 4, "_own": [True] * 4, "_t": [0, 5, 10, 10], "_e": [np.nan, np.nan, np.nan, 0.0], "_en": [False] * 3 + [True], "_k": [1, 2, 3, 4], "_kn": [False] * 4})
    assert recent_counts(x, np.array([False, True, True, True]), 5)["_n"].tolist() == [2, 2, 1]


def _plain_sessions(rows, gap):
    by, out = {}, []
    for u, t in rows:
        by.setdefault(u, []).append(t)
    for u, ts in by.items():
        ts.sort()
        start = last = ts[0]
        n = 0
        for t in ts:
            if t - last >= gap and n:
                out.append((u, start, last + gap, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((u, start, last + gap, n))
    return sorted(out)


def test_sessions_stitched_over_buckets_of_a_hot_user(spark):
    r = random.Random(9)
    rows = [("hot", T0 + dt.timedelta(minutes=r.randrange(6 * 1440))) for _ in range(1500)] + [("hot", T0 + dt.timedelta(minutes=5 * i)) for i in range(1200)]
    rows += [(f"u{i % 7}", T0 + dt.timedelta(minutes=r.randrange(6 * 1440))) for i in range(500)]
    rows += [("tie", T0)] * 4 + [("tie", T0 + dt.timedelta(minutes=30))] * 3 + [("border", T0 + dt.timedelta(hours=23, minutes=59)), ("border", T0 + dt.timedelta(hours=24, minutes=5))]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp").repartition(6)
    for seconds in (3600, 86400):
        got = sorted(map(tuple, bucketed_sessions(df, "user_id", "ts", "30 minutes", seconds).collect()))
        assert got == _plain_sessions(rows, dt.timedelta(minutes=30))
    plan = A.sessions(df)._jdf.queryExecution().optimizedPlan().toString()
    # windows over the events are by (user, bucket); only bucket summaries are ordered for each user
    assert "session_window" not in plan and "_b" in plan


def test_lag_by_ranges_of_any_key(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.6 else f"e{r.randrange(4)}", f"k{r.randrange(10 ** 6):07d}", i, r.choice("abc")) for i in range(800)]
    df = spark.createDataFrame(rows, "entity string, key string, n int, status string").repartition(4)
    got = ranged_lag(df, "entity", "key", ["status"], "n", ranges=9).collect()
    want, last = {}, {}
    for e, k, n, s in sorted(rows):
        want[n] = last.get(e, (None, None))
        last[e] = (k, s)
    assert {x["n"]: (x["prev_key"], x["prev_status"]) for x in got} == want and len(got) == 800


def test_transitions_ordered_by_a_number(spark):
    rows = [(f"e{i % 2}", i, s) for i, s in enumerate(["new", "new", "open", "done", "done", "new", "open", "open"])]
    bad = C.transition_violations(spark.createDataFrame(rows, "entity string, seq long, status string"), "entity", "seq", "status", {"new": ["open"], "open": ["done"]})
    assert sorted((r["entity"], r["seq"], r["from_status"], r["to_status"]) for r in bad.collect()) == [
        ("e0", 6, "done", "open"), ("e1", 3, "new", "done"), ("e1", 5, "done", "new")]


def test_unique_columns_by_one_shuffle(spark):
    rows = [(i, i % 50 if i < 100 else i, None if i % 3 == 0 else f"v{i}", [i // 2]) for i in range(300)] + [(300 + i, 7, "same", [9 ** 6 + i]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a int, b string, c array<int>").repartition(4)
    got = C.violations(df, [{"name": n, "required": False, "rules": ["unique"]} for n in ("id", "a", "b")], "id").collect()
    counts = {}
    for i, a, b, _ in rows:
        counts["a", a] = counts.get(("a", a), 0) + 1
        if b is not None:
            counts["b", b] = counts.get(("b", b), 0) + 1
    want = sorted((str(i), f) for i, a, b, _ in rows for f, v in (("a", a), ("b", b)) if v is not None and counts[f, v] > 1)
    assert sorted((r["row_key"], r["field"]) for r in got) == want
    plan = C.repeated_values(df, ["id", "a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and {r["check"] for r in got} == {"unique"}


def test_unique_values_are_dealt_out_before_they_are_counted(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(400)] + [(None, 7)] * 300, "id int, a int")
    found = C.repeated_values(df, ["id", "a"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # a plan is printed from its result down to the scan: no count stands below the exchange, in the tasks that read files
    assert plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")
    assert {(r["field"], bytes(r["digest"]).hex()) for r in found.collect()} == {("a", hashlib.md5(str(i).encode()).hexdigest()) for i in range(200)}


def test_values_of_a_group_as_plain_objects():
    given = [pd.Series([1.5, np.nan, 2.0]), pd.Series([1, 2]), pd.Series(["x", None]), pd.Series([True, False]), pd.Series([], dtype="float64"),
             pd.Series([[1, 2], None], dtype=object), pd.Series([pd.Timestamp(2024, 1, 1), pd.NaT])]
    assert [plain(s) for s in given] == [s.astype(object).where(s.notna(), None).tolist() for s in given]
    rows = [("a", 1, None, [1, 2]), ("b", 2 ** 60 + 1, 0.5, [3])]
    made = objects(rows, ["k", "n", "x", "l"])
    assert list(made.itertuples(index=False, name=None)) == rows and set(made.dtypes) == {np.dtype(object)}


def test_ids_of_any_padding_meet_in_a_stream(spark, tmp_path):
    forms = ["STU-00042", "STU-000042", " stu-42 ", "42", "STU-1000042", "XYZ-42", None, "STU-", "STU-000000", "STU-1234567"]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "i string").select(A.normalize_id("i", "STU-", 6)).collect()]
    assert got == ["STU-000042"] * 4 + [None] * 4 + ["STU-000000", None]
    spark.createDataFrame([(n, f) for n, f in enumerate(forms)], "n int, student_id string").write.parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([("STU-000042", "Ann"), ("bad", "Bob")], "id string, name string")
    stream = spark.readStream.schema("n int, student_id string").parquet(str(tmp_path / "in"))
    out = J.run_to_table(A.enrich_by_id(stream, table, "student_id", "id", "STU-", 6), str(tmp_path / "out"), str(tmp_path / "c"))
    assert {r["n"]: r["name"] for r in out.collect()} == {n: "Ann" if n < 4 else None for n in range(10)}
