"""Generator properties: determinism across partitionings, distributions, keys and caps."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import hashing as H
from tidewell.functions import spec as S
from tidewell.functions.rules import rule_column
from tidewell.plans import datasets as D
from tidewell.plans import streams as ST
from tidewell.sources.fixtures import Tables

from .conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["fraud_detection", "web_traffic", "k12_early_warning", "patient_vitals"])
def test_stream_rows_independent_of_partitioning(spark, name):
    a = ST.batch(spark, name, 400, partitions=1)
    b = ST.batch(spark, name, 400, partitions=2)
    c = ST.batch(spark, name, 400, partitions=8)
    ra = _rows(a)
    assert ra == _rows(b) == _rows(c)


def test_stream_batches_continue_ids(spark):
    whole = _rows(ST.batch(spark, "telemetry", 300))
    parts = _rows(ST.batch(spark, "telemetry", 100)) + _rows(ST.batch(spark, "telemetry", 200, offset=100))
    assert whole == sorted(parts)


def test_weighted_pick_shares_within_4_sigma(spark):
    n = 20000
    df = ST.batch(spark, "fraud_detection", n).groupBy("currency").count()
    counts = {r["currency"]: r["count"] for r in df.collect()}
    weights = {"USD": 5, "EUR": 2, "GBP": 1, "CAD": 1, "AUD": 1}
    for k, w in weights.items():
        p = w / 10
        mean, sd = n * p, (n * p * (1 - p)) ** 0.5
        assert abs(counts[k] - mean) < 4 * sd, (k, counts[k], mean)


def test_ranges_and_decimal_grid(spark):
    df = ST.batch(spark, "telemetry", 5000)
    r = df.agg(F.min("battery_level"), F.max("battery_level"), F.min("signal_strength_dbm"),
               F.max("signal_strength_dbm")).first()
    assert 0 <= float(r[0]) and float(r[1]) <= 100
    assert -120 <= r[2] and r[3] <= -30
    assert dict(df.dtypes)["reading_value"] == "decimal(10,4)"


def test_percent_nulls_and_omit(spark):
    spec = [{"name": "a", "type": "int", "min": 1, "max": 10, "random": True, "omit": True},
            {"name": "b", "type": "int", "expr": "a * 2"},
            {"name": "c", "type": "string", "values": ["x", "y"], "random": True, "percent_nulls": 50}]
    df = S.generate(spark, spec, 4000)
    assert df.columns == ["b", "c"]
    nulls = df.filter(F.col("c").isNull()).count()
    assert 1700 < nulls < 2300
    assert df.filter((F.col("b") < 2) | (F.col("b") > 20) | (F.col("b") % 2 != 0)).count() == 0


def test_spec_validation_rejects_bad_specs(spark):
    bad_type = [{"name": "x", "type": "not_a_real_type"}]
    assert S.trial(spark, bad_type)["valid"] is False
    with pytest.raises(S.SpecError):
        S.validate([{"name": "x", "values": [1, 2], "weights": [1]}])
    with pytest.raises(S.SpecError):
        S.validate([{"name": "x", "expr": "rand() < 0.5"}])
    ok = S.trial(spark, [{"name": "id", "type": "string", "uuid": True},
                         {"name": "value", "type": "int", "min": 1, "max": 100, "random": True},
                         {"name": "category", "type": "string", "values": ["A", "B", "C"], "weights": [5, 3, 2]}])
    assert ok["valid"] and "value" in ok["schema"]


def test_sequential_values_and_template(spark):
    spec = [{"name": "k", "type": "string", "values": ["a", "b", "c"]},
            {"name": "t", "type": "string", "template": "user_\\0", "min": 1, "max": 3}]
    rows = S.generate(spark, spec, 6).collect()
    assert [r["k"] for r in rows] == ["a", "b", "c", "a", "b", "c"]
    assert [r["t"] for r in rows] == ["user_1", "user_2", "user_3", "user_1", "user_2", "user_3"]


def test_rules_cover_every_generator(spark):
    k = F.col("id")
    rules = [{"generator": g} for g in ["uuid", "sequence", "range_int", "range_float", "bool", "date", "timestamp",
                                        "name", "email", "phone", "address", "random"]]
    rules += [{"generator": "choice", "values": []}, {"generator": "constant", "value": "x"},
              {"generator": "null_or", "null_percent": 100, "rule": {"generator": "sequence"}}]
    df = spark.range(50).select(*[rule_column(r, 1, f"c{i}", k, k + 1).cast("string").alias(f"c{i}")
                                  for i, r in enumerate(rules)])
    rows = df.collect()
    assert len(rows) == 50
    r0 = rows[0]
    assert len(r0["c0"]) == 36 and r0["c1"] == "000001"
    assert r0["c12"] is None and r0["c13"] == "x" and r0["c14"] is None
    assert len(r0["c11"]) == 8


def test_padded_never_truncates(spark):
    r = spark.range(1).select(H.padded("X-", F.lit(1234567), 3).alias("p")).first()
    assert r["p"] == "X-1234567"


def test_dataset_keys_unique_and_fks_match(spark):
    t = Tables(spark, SF_SMALL)
    st = D.students(t)
    assert st.count() == st.select("student_id").distinct().count() == t.customer.count()
    ev = D.enrollment_events(t)
    assert ev.join(st, "student_id", "left_anti").count() == 0
    assert ev.join(D.courses(t), "course_id", "left_anti").count() == 0
    k12 = D.k12_students(t)
    assert k12.join(D.schools(t), "school_id", "left_anti").count() == 0
    sr = D.service_requests(t)
    nulls = sr.filter(F.col("asset_id").isNull()).count() / sr.count()
    assert 0.2 < nulls < 0.4
