"""Contract checks on edge cases, transitions, and the table lifecycle operations."""

import os
import tempfile

from pyspark.sql import functions as F

from tidewell.operators import contracts as C
from tidewell.sources import tables as TB

from .conftest import SF_SMALL


def test_rules_and_types_edge_cases(spark):
    df = spark.createDataFrame(
        [(1, "a@b.co", " ", "-3", 0, "2024-01-31", "#fff"),
         (2, "bad", "ok", "7", 5, "2024-13-01", "rgb(1, 2, 3)"),
         (3, None, "x1", "x", -1, "nope", "blue")],
        "id int, email string, name string, r string, n int, d string, color string")
    contract = [
        {"name": "email", "type": "email", "required": True},
        {"name": "name", "rules": ["not empty", "alphanumeric", "unknown rule passes"]},
        {"name": "r", "rules": ["in range -5-5"]},
        {"name": "n", "rules": ["positive", "non-negative", "negative"]},
        {"name": "d", "type": "date"},
        {"name": "color", "type": "color_code"},
        {"name": "missing", "required": True},
    ]
    v = {(r["row_key"], r["field"], r["check"]) for r in C.violations(df, contract, "id").collect()}
    assert ("3", "email", "required") in v and ("2", "email", "type email") in v
    assert ("1", "name", "not empty") in v and ("1", "name", "alphanumeric") in v
    assert not any(c == "unknown rule passes" for _, _, c in v)
    assert ("2", "r", "in range -5-5") in v and ("3", "r", "in range -5-5") in v
    assert ("1", "r", "in range -5-5") not in v  # signed bounds parse
    assert ("1", "n", "positive") in v and ("1", "n", "negative") in v and ("3", "n", "non-negative") in v
    assert ("2", "d", "type date") in v and ("3", "d", "type date") in v and ("1", "d", "type date") not in v
    assert ("3", "color", "type color_code") in v and ("2", "color", "type color_code") not in v
    assert any(f == "missing" and c == "required" for _, f, c in v)


def test_uniqueness_and_summary(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, v string")
    v = C.violations(df, [{"name": "v", "rules": ["unique"]}], "id")
    assert sorted(r["row_key"] for r in v.collect()) == ["1", "2"]
    s = C.summary(df, [{"name": "v", "rules": ["length = 1", "contains a"]}]).collect()
    assert {(r["check"], r["failed"]) for r in s} == {("required", 0), ("length = 1", 0), ("contains a", 1)}


def test_status_transitions(spark):
    df = spark.createDataFrame([(1, 1, "pending"), (1, 2, "ready"), (1, 3, "completed"), (2, 1, "pending"),
                                (2, 2, "running")], "task int, ts int, status string")
    bad = C.transition_violations(df, "task", "ts", "status", C.VALID_STATUS_TRANSITIONS).collect()
    assert {(r["task"], r["from_status"], r["to_status"]) for r in bad} == {(1, "ready", "completed"),
                                                                           (2, "pending", "running")}


def test_table_lifecycle(spark):
    base = tempfile.mkdtemp(prefix="tw-tables-")
    path = os.path.join(base, "t")
    schema = "id long, name string"
    from pyspark.sql.types import _parse_datatype_string
    assert TB.create_if_absent(spark, path, _parse_datatype_string(schema)) is True
    assert TB.create_if_absent(spark, path, _parse_datatype_string(schema)) is False
    assert TB.append(spark.range(10).select("id", F.lit("x").alias("name")), path) == 10
    assert TB.append(spark.range(5).select("id", F.lit("y").alias("name")), path) == 5
    inv = {r["table_name"]: (r["row_count"], r["status"])
           for r in TB.inventory(spark, {"t": path, "gone": os.path.join(base, "gone")}).collect()}
    assert inv == {"t": (15, "ok"), "gone": (None, "not found")}
    assert TB.truncate(spark, path)["rows_deleted"] == 15
    assert TB.read_table(spark, path).count() == 0
    assert TB.truncate(spark, os.path.join(base, "nope"))["status"] == "table_not_found"
    assert TB.drop(spark, path) is True and not TB.exists(spark, path)
    d = TB.describe(spark.range(3).select("id", F.lit(1.5).cast("decimal(4,1)").alias("x")))
    assert [(r["column_name"], r["data_type"], r["row_count"]) for r in d.orderBy("position").collect()] == [
        ("id", "bigint", 3), ("x", "decimal(4,1)", 3)]


def test_upsert_replaces_by_key(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    u = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, TB.upsert(t, u, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]


def test_an_export_is_saved_and_read_back(spark, tmp_path):
    from tidewell.plans.graph_queries import h25_export_fund_flows
    from tidewell.sources.fixtures import Tables
    from tidewell.sources.tables import copy_table, read_table
    df = h25_export_fund_flows(Tables(spark, SF_SMALL))
    assert set(df.columns) == {
        "fund_id", "fund_name", "fund_category", "total_budget", "agency_id", "agency_name", "agency_type", "program_id",
        "program_name", "program_budget", "funded_amount"}
    path = str(tmp_path / "fund_flows")
    n = copy_table(df, path)
    assert n > 0 and sorted(map(str, read_table(spark, path).collect())) == sorted(map(str, df.collect()))


def test_validator_forms(spark):
    from pyspark.sql import types as T

    from tidewell.operators.contracts import IPV6, type_check
    good = ["::", "::1", "2001:db8::ff00:42:8329", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:1.2.3.4"]
    bad = ["1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8:9:a:b:c:d:e", "1::2::3", "12345::", "1:2:3", ":1", "1:", "::1.2.3.999"]
    df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "v string, ok boolean")
    assert df.filter(F.col("v").rlike(IPV6) != F.col("ok")).collect() == []
    times = [("2024-01-02", True), ("2024-01-02T03:04:05Z", True), ("2024-01-02 03:04:05.123+02:00", True), ("2024", False), ("2024-1", False), ("2024-13-01", False), ("x", False)]
    df = spark.createDataFrame(times, "v string, ok boolean")
    assert df.filter(type_check(F.col("v"), T.StringType(), "date_time") != F.col("ok")).collect() == []


def test_count_status_of_a_missing_table_is_zero(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    rows = TB.count_status(spark, {"t": str(tmp_path / "t"), "gone": str(tmp_path / "gone")}).collect()
    assert {r["table_name"]: r["row_count"] for r in rows} == {"t": 3, "gone": 0}


def test_coverage_lists(spark):
    stories = [(i, r) for i in range(400) for r in ("R1", "R2") if r == "R1" or i % 40 == 0] + [(7, "R1"), (8, "gone"), (None, "R2")]
    epics = [(900, "R2"), (901, "R2")]
    reqs = spark.createDataFrame([("R1",), ("R2",), ("R3",)], "id string")
    frame = lambda rows: spark.createDataFrame(rows, "item long, req string")
    rows = C.coverage_lists(reqs, "id", frame(stories), frame(epics), page_size=50).collect()
    got = {}
    for r in rows:
        assert r["ids"] == sorted(r["ids"]) and len(r["ids"]) < 100  # pages stay near their size
        got.setdefault((r["requirement"], r["kind"]), []).extend(r["ids"])
    want = {(q, k): sorted({i for i, r in links if r == q and i is not None}) for q in ("R1", "R2", "R3") for k, links in (("story", stories), ("epic", epics))}
    assert {k: sorted(v) for k, v in got.items()} == want and sum(r["requirement"] == "R1" and r["kind"] == "story" for r in rows) == 8
    assert [(r["page"], r["ids"]) for r in rows if r["requirement"] == "R3"] == [(0, []), (0, [])]
