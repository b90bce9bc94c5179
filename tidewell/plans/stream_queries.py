"""Batch form of the twelve streams, keyed on ``events.event_id``, with one
summary per stream (D1-D12).

The records are a pure function of the key, so the summary is the same on
any partitioning and equals what the streaming form produces for the same
ids. The aggregate is a hash aggregate with partial (map-side) combine; the
group keys are low-cardinality picks, so the shuffle carries only partial
rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import Tables
from .streams import over_keys

# stream -> (group columns, [(measure, column)]) ; measure in sum / avg / share
PROFILES: dict[str, tuple[list[str], list[tuple[str, str]]]] = {
    "fraud_detection": (["currency", "card_type"], [("sum", "amount"), ("avg", "merchant_id"), ("avg", "user_id")]),
    "telemetry": (["device_type"], [("sum", "reading_value"), ("avg", "signal_strength_dbm"),
                                    ("share", "anomaly_flag")]),
    "web_traffic": (["page_url", "device_type"], [("avg", "duration_ms"), ("avg", "http_status")]),
    "student_enrollment": (["semester", "action"], [("sum", "gpa_impact"), ("avg", "credits")]),
    "grant_budget": (["fund_category", "fiscal_year"], [("sum", "amount")]),
    "citizen_services": (["request_type", "priority"], [("avg", "response_time_hours"),
                                                        ("avg", "satisfaction_rating")]),
    "k12_early_warning": (["school_type", "event_type"], [("sum", "risk_score"), ("share", "free_reduced_lunch"),
                                                         ("share", "english_learner")]),
    "procurement": (["category", "procurement_method"], [("sum", "amount"), ("share", "minority_owned"),
                                                        ("avg", "contract_duration_months")]),
    "case_management": (["program", "determination"], [("sum", "benefit_amount"), ("avg", "household_size")]),
    "iot_sensors": (["device_type", "facility"], [("sum", "reading"), ("avg", "battery_pct"), ("share", "anomaly")]),
    "ecommerce_clicks": (["page", "action"], [("sum", "price"), ("avg", "duration_ms")]),
    "patient_vitals": (["ward"], [("avg", "heart_rate"), ("sum", "temperature_f"), ("share", "alert"),
                                  ("avg", "pain_level")]),
}

QUERY_NAMES = {
    "fraud_detection": "d1_card_transactions",
    "telemetry": "d2_device_telemetry",
    "web_traffic": "d3_web_clicks",
    "student_enrollment": "d4_course_enrolment",
    "grant_budget": "d5_grant_transactions",
    "citizen_services": "d6_citizen_requests",
    "k12_early_warning": "d7_school_early_warning",
    "procurement": "d8_procurement",
    "case_management": "d9_benefit_cases",
    "iot_sensors": "d10_iot_sensors",
    "ecommerce_clicks": "d11_shop_clicks",
    "patient_vitals": "d12_patient_vitals",
}


def measure(kind: str, col: str):
    c = F.col(col)
    if kind == "sum":
        return F.sum(c).cast("decimal(38,2)").cast("double").alias(f"total_{col}")
    if kind == "avg":
        return F.round(F.avg(c.cast("double")), 4).alias(f"avg_{col}")
    if kind == "share":
        return F.round(F.avg(c.cast("int").cast("double")), 4).alias(f"share_{col}")
    raise ValueError(kind)


def stream_summary(t: Tables, stream: str) -> DataFrame:
    group, measures = PROFILES[stream]
    recs = over_keys(t.events, "event_id", stream)
    return (recs.groupBy(*group)
            .agg(F.count("*").alias("records"), *[measure(k, c) for k, c in measures])
            .orderBy(F.desc("records"), *group))


def record_json(t: Tables, stream: str) -> DataFrame:
    """B15 + B17: each record as one JSON text with the key row's event time injected
    as an ISO-8601 UTC ``event_timestamp`` field (built on executors, never on the driver)."""
    recs = over_keys(t.events, "event_id", stream, ts=F.col("ts"))
    recs = (recs.withColumn("event_timestamp", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
            .drop("event_time"))
    body = [c for c in recs.columns if c != "row_id"]
    return recs.select("row_id", F.to_json(F.struct(*body)).alias("value"))
