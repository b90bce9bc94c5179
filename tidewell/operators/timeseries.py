"""Skew-safe per-entity time operators.

A window ``PARTITION BY entity ORDER BY ts`` sorts every entity's rows in one
task, so one hot entity (a third of all rows) becomes one giant task. These
helpers partition by (entity, time bucket) instead and carry the little
state that crosses a bucket border explicitly, so results are exact and no
task holds more than one entity-bucket:

* ``bucketed_lag``    previous row's columns per entity (the predecessor of a
                      bucket's first row is the last row of the entity's most
                      recent earlier bucket, found on the per-bucket summary)
* ``ranged_lag``      the same for an order key of any type: the buckets are
                      the ranges of a range partitioning by (entity, key)
* ``bucketed_sessions``  sessions per entity from the partial sessions of its
                      buckets; only pieces at a bucket's border are stitched
* ``bucketed_range_count``  number of the entity's rows in ``[ts - w, ts]``
                      (rows of the previous bucket's tail are copied in as
                      context, ``w`` <= bucket length)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bucket(ts: str, seconds: int):
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def bucketed_lag(df: DataFrame, entity: str, ts: str, cols: list[str], tiebreak: str | None = None,
                 bucket_seconds: int = 86400, prefix: str = "prev_") -> DataFrame:
    """Adds ``prev_<col>`` (and ``prev_<ts>``) = the entity's previous row by (ts, tiebreak)."""
    d = df.withColumn("_b", _bucket(ts, bucket_seconds))
    return _lag_over_buckets(d, entity, ts, cols, tiebreak, prefix).drop("_b")


def ranged_lag(df: DataFrame, entity: str, key: str, cols: list[str], tiebreak: str | None = None,
               prefix: str = "prev_", ranges: int | None = None) -> DataFrame:
    """Adds ``prev_<col>`` (and ``prev_<key>``) = the entity's previous row by (key, tiebreak), for a key of any type.

    Rows are range-partitioned by (entity, key, tiebreak), so a hot entity
    covers several ranges; the range is the bucket, and the last row of each
    is carried to the entity's next one. The rows are written with a reliable
    checkpoint first, so that all readers see one partitioning.
    """
    order = [entity, key] + ([tiebreak] if tiebreak else [])
    ranged = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    d = ranged.withColumn("_b", F.shiftright(F.monotonically_increasing_id(), 33)).checkpoint()
    return _lag_over_buckets(d, entity, key, cols, tiebreak, prefix).drop("_b")


def _lag_over_buckets(d: DataFrame, entity: str, key: str, cols: list[str], tiebreak: str | None, prefix: str) -> DataFrame:
    """The lag of rows with a bucket ``_b`` that ascends with the entity's order; keeps ``_b``."""
    order = [key] + ([tiebreak] if tiebreak else [])
    w = Window.partitionBy(entity, "_b").orderBy(*order)
    carried = [key] + [c for c in cols if c != key]
    for c in carried:
        d = d.withColumn(prefix + c, F.lag(c).over(w))
    d = d.withColumn("_first", F.row_number().over(w) == 1)
    # last row of each (entity, bucket), then the previous non-empty bucket's last row per entity
    last = d.groupBy(entity, "_b").agg(F.max_by(F.struct(*[F.col(c) for c in carried]),
                                                F.struct(*[F.col(c) for c in order])).alias("_last"))
    wb = Window.partitionBy(entity).orderBy("_b")
    prev_last = last.withColumn("_pl", F.lag("_last").over(wb)).select(entity, "_b", "_pl")
    d = d.join(prev_last, [entity, "_b"], "left")
    for c in carried:
        d = d.withColumn(prefix + c, F.when(F.col("_first"), F.col("_pl")[c]).otherwise(F.col(prefix + c)))
    return d.drop("_first", "_pl")


def bucketed_sessions(df: DataFrame, entity: str, ts: str, gap: str, bucket_seconds: int = 86400) -> DataFrame:
    """Sessions per entity: ``entity, session_start, session_end, events``; a session ends after ``gap`` without events.

    Every (entity, bucket) makes partial sessions of its own rows. A partial
    session that is neither the first of its bucket, continuing an earlier
    one, nor the last, which a later one may continue, is whole. The others,
    two at most for each bucket, are stitched along the entity's buckets. No
    task sorts more than the rows of one (entity, bucket).
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    width = F.expr(f"unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL '{gap}')")
    d = _lag_over_buckets(df.select(entity, ts).withColumn("_b", _bucket(ts, bucket_seconds)), entity, ts, [], None, "_prev_")
    before = F.unix_micros(F.col("_prev_" + ts).cast("timestamp"))
    d = d.withColumn("_new", F.when(before.isNull() | (micros - before >= width), 1).otherwise(0))
    # of equal times the one that starts the session comes first
    run = Window.partitionBy(entity, "_b").orderBy(ts, F.desc("_new")).rowsBetween(Window.unboundedPreceding, 0)
    parts = (d.withColumn("_s", F.sum("_new").over(run)).groupBy(entity, "_b", "_s")
             .agg(F.min(ts).alias("_start"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n"), F.max("_new").alias("_starts")))
    latest = parts.groupBy(entity, "_b").agg(F.max("_s").alias("_top"))
    parts = parts.join(latest, [entity, "_b"])
    border = (F.col("_s") == 0) | (F.col("_s") == F.col("_top"))
    chain = Window.partitionBy(entity).orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, 0)
    stitched = (parts.filter(border).withColumn("_chain", F.sum("_starts").over(chain)).groupBy(entity, "_chain")
                .agg(F.min("_start").alias("_start"), F.max("_last").alias("_last"), F.sum("_n").alias("_n")).drop("_chain"))
    whole = parts.filter(~border).select(*stitched.columns).unionByName(stitched)
    return whole.select(entity, F.col("_start").alias("session_start"),
                        (F.col("_last") + F.expr(f"INTERVAL '{gap}'")).alias("session_end"), F.col("_n").alias("events"))


def bucketed_range_count(df: DataFrame, entity: str, ts: str, window_seconds: int,
                         bucket_seconds: int = 3600, name: str = "recent") -> DataFrame:
    """Adds ``name`` = count of the entity's rows with ts in [ts - window, ts] (ties included)."""
    if window_seconds > bucket_seconds:
        raise ValueError("window must not exceed the bucket length")
    d = df.withColumn("_b", _bucket(ts, bucket_seconds)).withColumn("_ctx", F.lit(False))
    # copy the tail of each bucket into the next bucket as context rows
    tail_start = (F.col("_b") + 1) * F.lit(bucket_seconds * 1_000_000) - F.lit(window_seconds * 1_000_000)
    ctx = (d.filter(F.unix_micros(F.col(ts).cast("timestamp")) >= tail_start)
           .withColumn("_b", F.col("_b") + 1).withColumn("_ctx", F.lit(True)))
    u = d.unionByName(ctx)
    w = (Window.partitionBy(entity, "_b").orderBy(F.unix_micros(F.col(ts).cast("timestamp")))
         .rangeBetween(-window_seconds * 1_000_000, 0))
    return u.withColumn(name, F.count(F.lit(1)).over(w)).filter(~F.col("_ctx")).drop("_b", "_ctx")
