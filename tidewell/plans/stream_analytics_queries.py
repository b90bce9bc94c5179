"""§2.J stream analytics over the ``events`` table (batch form) and one
streaming run of the same operator (J2) over the events file as a stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.fixtures import Tables, table_path
from ..streaming import analytics as A
from ..streaming import jobs as J
from .streams import over_keys


def j2_error_rate(t: Tables) -> DataFrame:
    return A.tumbling_error_rate(t.events)


def j2_stream_error_rate(t: Tables) -> DataFrame:
    """J1 + J2 as a real stream: the events file read as a file stream, event-time watermark,
    5-minute windows in update mode, run to completion and read back latest-per-window."""
    spark = t.spark
    src = J.file_stream(spark, table_path(t.sf_dir, "events"), t.events.schema)
    src = src.withColumn("ts", F.col("ts").cast("timestamp"))  # event time must be TIMESTAMP (zone-aware)
    agg = A.tumbling_error_rate(src.withWatermark("ts", "1 hour"))
    run = uuid.uuid4().hex[:8]
    return J.upsert_run(agg, ["window_start"], scratch_path(spark, f"j2-out-{run}"),
                        scratch_path(spark, f"j2-ckpt-{run}"))


def j3_sliding_mean(t: Tables) -> DataFrame:
    return A.sliding_mean(t.events)


def j3_zscore_outliers(t: Tables) -> DataFrame:
    return A.zscore_outliers(t.events, z=2.0).groupBy("event_type").agg(F.count("*").alias("outliers"))


def j4_sessions(t: Tables) -> DataFrame:
    return A.session_summary(t.events)


def j5_velocity(t: Tables) -> DataFrame:
    v = A.velocity(t.events, window_seconds=3600, threshold=2)
    return v.groupBy("user_id").agg(F.count("*").alias("flagged_events"))


def j6_impossible_travel(t: Tables) -> DataFrame:
    pts = over_keys(t.events, "event_id", "fraud_detection", carry={"ts": "ts", "card_holder": "user_id"})
    pts = pts.select(F.col("row_id").alias("event_id"), "latitude", "longitude", "ts", "card_holder")
    flagged = A.impossible_travel(pts, "card_holder", "ts", "latitude", "longitude", "event_id")
    return flagged.groupBy("card_holder").agg(F.count("*").alias("flagged_moves"))


def j7_low_battery(t: Tables) -> DataFrame:
    tel = over_keys(t.events, "event_id", "telemetry", carry={"ts": "ts", "device": "user_id"})
    tel = tel.select(F.col("row_id").alias("event_id"), "battery_level", "ts", "device")
    alerts = A.crossing_alerts(tel, "device", "ts", "battery_level", "event_id", 20.0)
    return alerts.groupBy("device").agg(F.count("*").alias("alerts"))


def _event_stream(t: Tables) -> DataFrame:
    src = J.file_stream(t.spark, table_path(t.sf_dir, "events"), t.events.schema)
    return src.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df: DataFrame, name: str) -> DataFrame:
    """Run a stream in append mode to its end and read back what it wrote."""
    run = f"{name}-{uuid.uuid4().hex[:8]}"
    return J.run_to_table(df, scratch_path(df.sparkSession, f"{run}-out"), scratch_path(df.sparkSession, f"{run}-ckpt"))


# The three that follow run over the whole events table as a stream. Its files come in one micro-batch, so a watermark
# without delay lets the last events out as well.
def j5_stream_velocity(t: Tables) -> DataFrame:
    v = _run(A.velocity(_event_stream(t), window_seconds=3600, threshold=2, delay="0 seconds"), "j5")
    return v.groupBy("user_id").agg(F.count("*").alias("flagged_events"))


def j6_stream_impossible_travel(t: Tables) -> DataFrame:
    pts = over_keys(_event_stream(t), "event_id", "fraud_detection", carry={"ts": "ts", "card_holder": "user_id"})
    pts = pts.select(F.col("row_id").alias("event_id"), "latitude", "longitude", "ts", "card_holder")
    flagged = _run(A.impossible_travel(pts, "card_holder", "ts", "latitude", "longitude", "event_id", delay="0 seconds", idle="1000 days"), "j6")
    return flagged.groupBy("card_holder").agg(F.count("*").alias("flagged_moves"))


def j7_stream_low_battery(t: Tables) -> DataFrame:
    tel = over_keys(_event_stream(t), "event_id", "telemetry", carry={"ts": "ts", "device": "user_id"})
    tel = tel.select(F.col("row_id").alias("event_id"), "battery_level", "ts", "device")
    alerts = _run(A.crossing_alerts(tel, "device", "ts", "battery_level", "event_id", 20.0, delay="0 seconds", idle="1000 days"), "j7")
    return alerts.groupBy("device").agg(F.count("*").alias("alerts"))


def j12_stream_normalized_ids(t: Tables) -> DataFrame:
    """F12 + J12: events carry five-digit customer ids, the table six-digit ones; the stream meets the table on the
    normalised id."""
    ids = F.concat(F.lit("CUS-"), F.lpad(F.col("user_id").cast("string"), 5, "0"))
    events = _event_stream(t).select("event_id", ids.alias("customer_id"))
    table = t.customer.select(F.concat(F.lit("CUS-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("id"), "c_custkey", "c_mktsegment")
    e = _run(A.enrich_by_id(events, table, "customer_id", "id", "CUS-", 6).select("event_id", "c_custkey", "c_mktsegment"), "j12")
    return e.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("events"), F.count_distinct("c_custkey").alias("customers"))


def j8_funnel(t: Tables) -> DataFrame:
    return A.funnel(t.events, "user_id", "ts", "event_type", ["view", "click", "purchase"])


def j9_shares(t: Tables) -> DataFrame:
    return A.shares(t.events, "event_type")


FIRMWARE = ["1.0.0", "1.1.0", "1.2.3", "2.0.0", "2.1.0"]


def j10_firmware_rollout(t: Tables) -> DataFrame:
    tel = over_keys(t.events.select("event_id", "ts"), "event_id", "telemetry", ts=F.col("ts"))
    return A.rollout(tel, "event_time", "firmware_version", FIRMWARE)


def j11_dedupe(t: Tables) -> DataFrame:
    keyed = t.events.withColumn("minute", F.date_trunc("minute", "ts"))
    d = A.dedupe(keyed, ["user_id", "event_type", "minute"])
    return d.groupBy("event_type").agg(F.count("*").alias("unique_events"))


def j12_enrich(t: Tables) -> DataFrame:
    e = A.enrich(t.events, t.customer, "user_id", "c_custkey")
    return e.groupBy("c_mktsegment").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))


def j13_dead_letters(t: Tables) -> DataFrame:
    recs = (t.events.select(F.col("props").alias("value"))
            .unionByName(t.conversations.select(F.col("text").alias("value"))))
    good, dead = A.split_dead_letters(recs, "k INT")
    g = good.agg(F.count("*").alias("n"), F.sum("k").alias("k_sum")).select(F.lit("decoded").alias("kind"), "n",
                                                                            "k_sum")
    d = dead.agg(F.count("*").alias("n")).select(F.lit("dead_letter").alias("kind"), "n",
                                                F.lit(None).cast("bigint").alias("k_sum"))
    return g.unionByName(d)
