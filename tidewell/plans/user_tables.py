"""User-declared tables (C17) and the two example tables.

A user table is a list of ``{"name", "sql_type", "primary_key", "generator_rule"}``
entries; the rows are generated from a key column with the JSON rule engine
(``functions.rules``) and cast to the declared SQL types. Nothing runs per
row in Python and no rows reach the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import rule_column
from ..sources.fixtures import Tables

_TYPE_MAP = [
    (re.compile(r"^(VAR)?CHAR(\s*\(\d+\))?$|^TEXT$|^STRING$", re.I), "string"),
    (re.compile(r"^(INT|INTEGER|INT4)$", re.I), "int"),
    (re.compile(r"^(BIGINT|INT8|LONG)$", re.I), "bigint"),
    (re.compile(r"^(SMALLINT|INT2)$", re.I), "smallint"),
    (re.compile(r"^(REAL|FLOAT4|FLOAT)$", re.I), "float"),
    (re.compile(r"^(DOUBLE( PRECISION)?|FLOAT8)$", re.I), "double"),
    (re.compile(r"^BOOL(EAN)?$", re.I), "boolean"),
    (re.compile(r"^DATE$", re.I), "date"),
    (re.compile(r"^TIMESTAMP(TZ)?( WITH(OUT)? TIME ZONE)?$", re.I), "timestamp"),
]
_DECIMAL = re.compile(r"^(DECIMAL|NUMERIC)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)$", re.I)


def spark_type(sql_type: str) -> str:
    """Map a SQL column type (free text, as users write it) to a Spark type name."""
    s = sql_type.strip()
    m = _DECIMAL.match(s)
    if m:
        return f"decimal({m.group(2)},{m.group(3)})"
    for rx, t in _TYPE_MAP:
        if rx.match(s):
            return t
    raise ValueError(f"unsupported sql_type {sql_type!r}")


def build_user_table(keys: DataFrame, key: str, columns: list[dict], table: str, seed=42) -> DataFrame:
    """One row per key; ``sequence``/``email`` numbers are key + 1."""
    k = F.col(key)
    seq = k.cast("bigint") + F.lit(1)
    sel = []
    for c in columns:
        v = rule_column(c.get("generator_rule"), f"{seed}/{table}", c["name"], k, seq)
        sel.append(v.cast(spark_type(c.get("sql_type", "TEXT"))).alias(c["name"]))
    return keys.select(*sel)


def primary_keys(columns: list[dict]) -> list[str]:
    return [c["name"] for c in columns if c.get("primary_key")]


# FIXED VALUES: the two example table specs
SURVEY_COLUMNS = [
    {"name": "response_id", "sql_type": "VARCHAR(40)", "primary_key": True, "generator_rule": {"generator": "uuid"}},
    {"name": "respondent", "sql_type": "VARCHAR(100)", "generator_rule": {"generator": "name"}},
    {"name": "email", "sql_type": "VARCHAR(120)",
     "generator_rule": {"generator": "email", "domain": "survey-users.com"}},
    {"name": "overall_score", "sql_type": "INT", "generator_rule": {"generator": "range_int", "min": 1, "max": 10}},
    {"name": "nps_score", "sql_type": "INT", "generator_rule": {"generator": "range_int", "min": 0, "max": 10}},
    {"name": "category", "sql_type": "VARCHAR(20)",
     "generator_rule": {"generator": "choice", "values": ["promoter", "passive", "detractor"], "weights": [5, 3, 2]}},
    {"name": "product", "sql_type": "VARCHAR(30)",
     "generator_rule": {"generator": "choice", "values": ["Platform", "Mobile App", "API", "Dashboard", "Analytics"]}},
    {"name": "submitted_at", "sql_type": "DATE",
     "generator_rule": {"generator": "date", "start": "2024-01-01", "end": "2025-12-31"}},
    {"name": "country", "sql_type": "VARCHAR(5)",
     "generator_rule": {"generator": "choice", "values": ["US", "UK", "DE", "FR", "CA", "AU", "JP", "BR"]}},
]

FLEET_COLUMNS = [
    {"name": "event_id", "sql_type": "VARCHAR(40)", "primary_key": True, "generator_rule": {"generator": "uuid"}},
    {"name": "vehicle_id", "sql_type": "VARCHAR(12)",
     "generator_rule": {"generator": "sequence", "prefix": "VH-", "width": 5}},
    {"name": "driver", "sql_type": "VARCHAR(100)", "generator_rule": {"generator": "name"}},
    {"name": "vehicle_type", "sql_type": "VARCHAR(20)",
     "generator_rule": {"generator": "choice", "values": ["sedan", "suv", "van", "truck", "bus"],
                        "weights": [4, 3, 2, 3, 1]}},
    {"name": "event_type", "sql_type": "VARCHAR(20)",
     "generator_rule": {"generator": "choice",
                        "values": ["ignition_on", "ignition_off", "speeding", "hard_brake", "idle", "geofence_enter",
                                   "geofence_exit", "maintenance_due"],
                        "weights": [4, 4, 2, 2, 3, 1, 1, 1]}},
    {"name": "speed_mph", "sql_type": "INT", "generator_rule": {"generator": "range_int", "min": 0, "max": 95}},
    {"name": "fuel_pct", "sql_type": "DECIMAL(5,2)",
     "generator_rule": {"generator": "range_float", "min": 5.0, "max": 100.0}},
    {"name": "odometer_miles", "sql_type": "INT",
     "generator_rule": {"generator": "range_int", "min": 1000, "max": 200000}},
    {"name": "latitude", "sql_type": "DECIMAL(8,5)",
     "generator_rule": {"generator": "range_float", "min": 25.0, "max": 48.0, "precision": 5}},
    {"name": "longitude", "sql_type": "DECIMAL(9,5)",
     "generator_rule": {"generator": "range_float", "min": -125.0, "max": -70.0, "precision": 5}},
    {"name": "event_time", "sql_type": "TIMESTAMPTZ",
     "generator_rule": {"generator": "timestamp", "start": "2024-06-01T00:00:00", "end": "2025-12-31T23:59:59"}},
]


def survey_responses(t: Tables, seed=42) -> DataFrame:
    """One survey response per ``events`` row."""
    return build_user_table(t.events, "event_id", SURVEY_COLUMNS, "survey_responses", seed)


def vehicle_events(t: Tables, seed=42) -> DataFrame:
    """One fleet event per ``orders`` row."""
    return build_user_table(t.orders, "o_orderkey", FLEET_COLUMNS, "vehicle_events", seed)
