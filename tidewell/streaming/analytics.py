"""Stream analytics (J1-J13) written once for batch and streaming DataFrames.

Each function takes an events-shaped DataFrame (``ts`` event time plus the
stream's columns) and returns the analytic; the same function is used on a
bounded table (batch, oracle-checked) and on a streaming read with a
watermark (``streaming.jobs``). What depends on an entity's order uses the
skew-safe bucketed operators of ``operators.timeseries`` on a bounded table
and the keyed state of ``streaming.state`` on a stream.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timeseries import bucketed_lag, bucketed_range_count, bucketed_sessions
from .state import interval_count, stream_lag


def with_event_time(df: DataFrame, col: str = "event_timestamp", watermark: str | None = None,
                    name: str = "event_time") -> DataFrame:
    """Parse the ISO text timestamp of a record and (streams) declare the watermark."""
    out = df.withColumn(name, F.to_timestamp(F.col(col)))
    return out.withWatermark(name, watermark) if watermark else out


def tumbling_error_rate(df: DataFrame, ts: str = "ts", width: str = "5 minutes", is_error: Column | None = None):
    """Events per tumbling window and the share of error events."""
    err = is_error if is_error is not None else (F.col("event_type") == "error")
    return (df.groupBy(F.window(ts, width).alias("w"))
            .agg(F.count("*").alias("events"), F.sum(err.cast("int")).alias("errors"))
            .select(F.col("w.start").alias("window_start"), "events", "errors",
                    F.round(F.col("errors") / F.col("events"), 4).alias("error_rate")))


def sliding_mean(df: DataFrame, ts: str = "ts", value: str = "value", group: str = "event_type",
                 width: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Sliding-window mean and count of a value per group."""
    return (df.groupBy(F.window(ts, width, slide).alias("w"), group)
            .agg(F.count("*").alias("events"), F.round(F.avg(value), 4).alias("mean_value"))
            .select(F.col("w.start").alias("window_start"), group, "events", "mean_value"))


def zscore_outliers(df: DataFrame, value: str = "value", group: str = "event_type", z: float = 3.0) -> DataFrame:
    """J3 (batch): rows more than ``z`` standard deviations from their group's mean.

    Group statistics are one aggregate joined back; with few groups AQE
    broadcasts it (measured size), with many it stays a shuffle join.
    """
    stats = df.groupBy(group).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    j = df.join(stats, group)
    return j.filter(F.abs(F.col(value) - F.col("_mu")) > F.lit(z) * F.col("_sd")).drop("_mu", "_sd")


def sessions(df: DataFrame, entity: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Sessions per entity (a session closes after ``gap`` without events): Spark's session windows on a stream,
    partial sessions by time bucket, stitched at the borders, on a bounded table."""
    if not df.isStreaming:
        return bucketed_sessions(df, entity, ts, gap)
    s = (df.groupBy(entity, F.session_window(ts, gap).alias("s"))
         .agg(F.count("*").alias("events")))
    return s.select(entity, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def session_summary(df: DataFrame, entity: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    s = sessions(df, entity, ts, gap)
    dur = F.unix_timestamp("session_end") - F.unix_timestamp("session_start")
    return (s.groupBy(entity).agg(F.count("*").alias("sessions"), F.sum("events").alias("events"),
                                  F.round(F.avg(dur), 2).alias("avg_session_seconds")))


def velocity(df: DataFrame, entity: str = "user_id", ts: str = "ts", window_seconds: int = 600,
             threshold: int = 3, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Events whose entity had more than ``threshold`` events in the preceding window (inclusive).

    On a stream (``key`` tells its events apart, ``delay`` is the watermark) an event is judged once the watermark has
    passed it; events later than that are dropped.
    """
    if df.isStreaming:
        c = interval_count(df, entity, ts, key, window_seconds, delay, "recent")
    else:
        c = bucketed_range_count(df, entity, ts, window_seconds, name="recent")
    return c.filter(F.col("recent") > threshold)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    r = math.pi / 180.0
    dlat = (lat2 - lat1) * r
    dlon = (lon2 - lon1) * r
    a = F.sin(dlat / 2) ** 2 + F.cos(lat1 * r) * F.cos(lat2 * r) * F.sin(dlon / 2) ** 2
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


def lag_by_entity(df: DataFrame, entity: str, ts: str, cols: list[str], tiebreak: str, delay: str, idle: str) -> DataFrame:
    """``prev_`` columns of the entity's previous row by (ts, tiebreak), for tables and streams."""
    if df.isStreaming:
        return stream_lag(df, entity, ts, cols, tiebreak, delay, idle)
    return bucketed_lag(df, entity, ts, cols, tiebreak=tiebreak)


def impossible_travel(df: DataFrame, entity: str, ts: str, lat: str, lon: str, tiebreak: str,
                      max_kmh: float = 900.0, delay: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """Consecutive points of an entity implying a speed above ``max_kmh``.

    On a stream ``delay`` is the watermark and ``idle`` the event time after which a silent entity's last point is
    forgotten.
    """
    d = df.select(entity, ts, tiebreak, F.col(lat).cast("double").alias("lat"),
                  F.col(lon).cast("double").alias("lon"))
    p = lag_by_entity(d, entity, ts, ["lat", "lon", tiebreak], tiebreak, delay, idle)
    p = p.filter(F.col("prev_lat").isNotNull())
    km = haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    hours = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("prev_" + ts).cast("timestamp"))) / F.lit(3.6e9)
    speed = F.when(hours > 0, km / hours)
    return p.select(entity, ts, tiebreak, F.round(km, 3).alias("km"), F.round(speed, 3).alias("kmh")).filter(
        (F.col("kmh") > max_kmh) | ((F.col("kmh").isNull()) & (F.col("km") > 0)))


def crossing_alerts(df: DataFrame, entity: str, ts: str, level: str, tiebreak: str, limit: float = 20.0,
                    delay: str = "10 minutes", idle: str = "30 days"):
    """One alert per downward crossing of ``limit`` (previous >= limit, current < limit); streams as in J6."""
    d = df.select(entity, ts, tiebreak, F.col(level).cast("double").alias("level"))
    p = lag_by_entity(d, entity, ts, ["level", tiebreak], tiebreak, delay, idle)
    return p.filter((F.col("level") < limit) & (F.col("prev_level") >= limit)).select(entity, ts, tiebreak, "level")


def funnel(df: DataFrame, entity: str, ts: str, step_col: str, steps: list[str]) -> DataFrame:
    """Entities reaching each step; a step is reached by its first event at or after the step before was reached.

    Every step joins the events of its kind to the entities that came so far
    and keeps one time for each, combined before the shuffle.
    """
    ev = df.select(F.col(entity).alias("_e"), F.col(ts).alias("_ts"), F.col(step_col).alias("_s"))
    reached, counts = None, []
    for i, s in enumerate(steps):
        own = ev.filter(F.col("_s") == s)
        if reached is not None:
            own = own.join(reached, "_e").filter(F.col("_ts") >= F.col("_t"))
        reached = own.groupBy("_e").agg(F.min("_ts").alias("_t"))
        counts.append(reached.select(F.count("_t")).scalar().alias(f"step{i + 1}_{s}"))
    return df.sparkSession.range(1).select(*counts)


def shares(df: DataFrame, col: str) -> DataFrame:
    """Count per value and its share of all rows.

    The total is a scalar subquery (one aggregate), not ``sum(count) over ()``,
    which would move every group row into one task when the column has many values.
    """
    c = df.groupBy(col).agg(F.count("*").alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return c.withColumn("share", F.round(F.col("n") / total, 4))


def rollout(df: DataFrame, ts: str, version: str, versions: list[str], width: str = "1 day") -> DataFrame:
    """Events per window and version, one column per version (pivot on a fixed list)."""
    return (df.groupBy(F.window(ts, width).start.alias("window_start"))
            .pivot(version, versions).agg(F.count(F.lit(1))).na.fill(0).orderBy("window_start"))


def dedupe(df: DataFrame, keys: list[str], ts: str | None = None, watermark: str | None = None) -> DataFrame:
    """Drop repeated records; streams use ``dropDuplicatesWithinWatermark`` (bounded state)."""
    if df.isStreaming and ts and watermark:
        return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def enrich(stream: DataFrame, table: DataFrame, stream_key: str, table_key: str) -> DataFrame:
    """Stream-static left join (the static side is re-read per micro-batch, never collected)."""
    return stream.join(table, stream[stream_key] == table[table_key], "left")


def write_split(records: DataFrame, schema: str, good_path: str, dead_path: str, checkpoint: str, value: str = "value"):
    """J13 as a stream with two sinks: decoded records to one table, malformed ones with their raw text to another.

    Both are written in one pass over each micro-batch, under ``batch_id=<id>`` with overwrite, so a replayed batch
    replaces its own output in both.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for part, path in zip(split_dead_letters(batch, schema, value), (good_path, dead_path)):
            part.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_dead_letters(records: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Decode JSON text; malformed records go to a dead-letter frame with their raw text."""
    full = f"{schema}, _corrupt_record STRING"
    parsed = records.withColumn("_d", F.from_json(F.col(value).cast("string"), full,
                                                  {"mode": "PERMISSIVE",
                                                   "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("_d").isNull() | F.col("_d._corrupt_record").isNotNull()
    good = parsed.filter(~bad).select("*", "_d.*").drop("_d", "_corrupt_record")
    dead = parsed.filter(bad).select(F.col(value).cast("string").alias("raw")).withColumn(
        "reason", F.lit("malformed_json"))
    return good, dead


def normalize_id(col: Column | str, prefix: str, width: int) -> Column:
    """an id of any zero padding in the one form of ``width`` digits: ``STU-00042`` and ``stu-42`` as ``STU-000042``.

    White space around it and the case of the prefix do not matter; digits alone get the prefix. What is no such id, or
    has more significant digits than ``width``, is null, so it meets nothing.
    """
    c = F.col(col) if isinstance(col, str) else col
    digits = F.regexp_extract(F.upper(F.trim(c.cast("string"))), f"^(?:{re.escape(prefix.upper())})?0*([0-9]{{1,{width}}})$", 1)
    return F.when(digits != "", F.concat(F.lit(prefix), F.lpad(digits, width, "0")))


def enrich_by_id(stream: DataFrame, table: DataFrame, stream_key: str, table_key: str, prefix: str, width: int) -> DataFrame:
    """J12 with ids of different padding: both sides meet on the normalised id; rows of the stream without one are kept."""
    s = stream.withColumn("_sid", normalize_id(stream_key, prefix, width))
    t = table.withColumn("_tid", normalize_id(table_key, prefix, width)).filter(F.col("_tid").isNotNull())
    return s.join(t, s["_sid"] == t["_tid"], "left").drop("_sid", "_tid")
