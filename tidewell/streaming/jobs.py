"""Structured Streaming jobs: sources, decode, sinks and run control.

* ``topic_source``   A1  Kafka topic when the connector is on the classpath,
                     otherwise a folder of JSON-lines files read as a stream
                     with the same ``value`` column
* ``decode``         A2  ``from_json`` of ``value`` into typed columns
* ``generator``      D13 a stream generator: ``rate-micro-batch`` row ids ->
                     column spec -> JSON records -> sink, with a trigger
                     interval, a time limit and progress from ``lastProgress``
* ``to_table``       A10 append a stream to a parquet table with a checkpoint
* ``preview``        A13 a view of the latest micro-batch's first rows, with a
                     fresh checkpoint
* ``dual_write``     A23 each micro-batch goes to the topic and to an audit
                     table and is then listed in a manifest, by which readers
                     see it in both or in none
* ``upsert_run``     windowed aggregations in ``update`` mode written per batch
                     and read back as the latest row per key

All checkpoints live below the shared ``spark.checkpoint.dir`` folder, so a
restarted driver or lost executor resumes from the last committed batch.
"""

from __future__ import annotations

import os
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.spec import apply_spec
from ..session import scratch_path
from ..sources.fixtures import path_exists

KAFKA_FORMAT = "kafka"


def topic_source(spark: SparkSession, topic: str, options: dict | None = None, folder: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A1: subscribe to one topic from the earliest offset (SASL etc. via ``options``).

    The caller chooses the source: with ``folder`` the topic is that folder of
    JSON-lines files, else a Kafka topic (its connector must be on the
    classpath). The folder form has the Kafka columns that a file can give:
    key (null), value, topic, partition (0) and timestamp, the file's time, so
    a replay sees the same values.
    """
    if folder is None:
        r = (spark.readStream.format(KAFKA_FORMAT).option("subscribe", topic)
             .option("startingOffsets", "earliest"))
        for k, v in (options or {}).items():
            r = r.option(k, v)
        return r.load()
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder).select(F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
                                 F.lit(topic).alias("topic"), F.lit(0).alias("partition"),
                                 F.col("_metadata.file_modification_time").alias("timestamp"))


def to_topic(df: DataFrame, topic: str, options: dict, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Produce a stream's ``value`` column to a Kafka topic (the connector must be on the classpath)."""
    w = df.select("value").writeStream.format(KAFKA_FORMAT).option("topic", topic).option("checkpointLocation", checkpoint)
    for k, v in options.items():
        w = w.option(k, v)
    return (w.trigger(availableNow=True) if available_now else w).start()


def decode(df: DataFrame, schema: str) -> DataFrame:
    """A2: ``value`` -> typed columns; malformed JSON gives an all-null row (kept, as in the source)."""
    return df.select(F.from_json(F.col("value").cast("string"), schema).alias("data")).select("data.*")


def generator(spark: SparkSession, spec: list[dict], sink_folder: str, rows_per_batch: int = 100,
              interval_seconds: float = 1.0, partitions: int = 2, seed=42, checkpoint: str | None = None,
              start_timestamp_ms: int = 0, fmt: str = "text", fast: bool = False) -> StreamingQuery:
    """Start a stream generator writing JSON records (one per line) to ``sink_folder``.

    Row ids continue across micro-batches (``rate-micro-batch``), so every
    record is a pure function of (seed, id): a restart from the checkpoint
    produces no duplicates and no gaps. ``event_timestamp`` is the source's
    event time in ISO-8601 UTC.
    """
    if interval_seconds < 0.1:
        raise ValueError(f"interval_seconds must be 0.1 or more, not {interval_seconds}")
    src = (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)
           .option("numPartitions", partitions).option("startTimestamp", start_timestamp_ms)
           .option("advanceMillisPerBatch", int(interval_seconds * 1000)).load())
    rows = apply_spec(src.withColumnRenamed("value", "_id"), spec, key="_id", seed=seed, keep=["_id", "timestamp"],
                      fast=fast)
    rows = rows.withColumn("event_timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
    body = [c for c in rows.columns if c not in ("_id", "timestamp")]
    out = rows.select(F.to_json(F.struct(*body)).alias("value"))
    ckpt = checkpoint or scratch_path(spark, f"gen-{uuid.uuid4().hex[:8]}")
    return (out.writeStream.format(fmt).option("path", sink_folder).option("checkpointLocation", ckpt)
            .trigger(processingTime=f"{interval_seconds} seconds").start())


def run_for(q: StreamingQuery, timeout_seconds: float) -> dict:
    """Run control: wait up to ``timeout_seconds`` then stop; returns rows produced and status.

    Spark keeps the progress of the last hundred batches only, so it is read
    again and again while the query runs and added up by batch.
    """
    rows: dict[int, int] = {}
    end = time.time() + timeout_seconds
    while True:
        left = end - time.time()
        q.awaitTermination(max(0.05, min(left, 0.5)))
        rows.update({p["batchId"]: p["numInputRows"] for p in q.recentProgress})
        if left <= 0 or not q.isActive:
            break
    status = "error" if q.exception() else ("running" if q.isActive else "completed")
    q.stop()
    rows.update({p["batchId"]: p["numInputRows"] for p in q.recentProgress})
    return {"rows_produced": sum(rows.values()), "batches": len(rows), "status": status if status != "running" else "stopped"}


def to_table(df: DataFrame, path: str, checkpoint: str, available_now: bool = True, table: str | None = None):
    """A10: append a stream to a parquet table (``toTable`` when a catalog name is given)."""
    w = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    if table:
        return w.option("path", path).toTable(table)
    return w.option("path", path).start()


def run_to_table(df: DataFrame, path: str, checkpoint: str, state_partitions: int | None = None) -> DataFrame:
    """Run a stream in append mode to the end of its present input and read back the table (its state partitions as in
    ``upsert_run``)."""
    with state_partitioning(df.sparkSession, state_partitions):
        q = to_table(df, path, checkpoint)
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def state_partitioning(spark: SparkSession, n: int | None = None):
    """Streaming state is partitioned by ``spark.sql.shuffle.partitions`` when a query first starts (AQE does not resize
    it): sets it to ``n`` or the cluster's default parallelism, and restores it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def preview(df: DataFrame, name: str, rows: int = 1000) -> StreamingQuery:
    """Show a running stream as the view ``name``, with a fresh scratch checkpoint: the first ``rows`` rows of the latest
    micro-batch that had any, whatever the stream's size. Nothing is kept in the driver; the view reads a scratch table."""
    spark = df.sparkSession
    base = scratch_path(spark, f"preview-{name}-{uuid.uuid4().hex[:8]}")

    def show(batch: DataFrame, batch_id: int) -> None:
        first = f"{base}/out/batch_id={batch_id}"
        batch.limit(rows).write.mode("overwrite").parquet(first)
        shown = batch.sparkSession.read.schema(batch.schema).parquet(first)
        if batch_id == 0 or not shown.isEmpty():
            shown.createOrReplaceGlobalTempView(name)

    spark.createDataFrame([], df.schema).createOrReplaceGlobalTempView(name)
    return df.writeStream.foreachBatch(show).option("checkpointLocation", f"{base}/ckpt").start()


def dual_write(df: DataFrame, topic_folder: str | None, audit_path: str, checkpoint: str, topic: str, user_id: str,
               available_now: bool = True, kafka: dict | None = None) -> StreamingQuery:
    """Every message (``value``, ``timestamp``) goes to the topic and to the audit table.

    The caller chooses the topic: with ``kafka`` (connector options) a Kafka
    topic, else the folder ``topic_folder``. A batch is committed by a manifest
    entry that is written after both sinks, so readers who go by it
    (``committed``) see a batch in both or in none, and a batch that is in it is
    not written again. A batch that failed between the sinks is replayed: folders
    are written under ``batch_id=<id>`` with overwrite, and Kafka messages carry
    ``message_id`` in their headers, the same on a replay, by which a consumer
    drops what it has seen (``message_ids``).
    """
    if (topic_folder is None) == (kafka is None):
        raise ValueError("choose one of topic_folder and kafka")

    def to_topic_sink(msgs: DataFrame, batch_id: int) -> None:
        if kafka is not None:
            header = F.array(F.struct(F.lit("message_id").alias("key"), F.col("message_id").cast("binary").alias("value")))
            (msgs.select("value", header.alias("headers")).write.format(KAFKA_FORMAT).options(**kafka).option("topic", topic)
             .option("includeHeaders", "true").save())
        else:
            msgs.select("value").write.mode("overwrite").text(os.path.join(topic_folder, f"batch_id={batch_id}"))

    def to_audit(msgs: DataFrame, batch_id: int) -> None:
        (msgs.select(F.lit("message_sent").alias("event_type"), F.lit(user_id).alias("user_id"),
                     F.lit(topic).alias("topic_name"), F.col("value").alias("topic_message"),
                     F.col("timestamp").alias("created_at"))
         .write.mode("overwrite").parquet(os.path.join(audit_path, f"batch_id={batch_id}")))

    return write_together(df, [to_topic_sink, to_audit], manifest_path(audit_path), checkpoint, available_now)


def manifest_path(audit_path: str) -> str:
    """Where the batches that both sinks have are listed (a hidden folder of the audit table)."""
    return os.path.join(audit_path, "_commits")


def message_ids(batch: DataFrame, batch_id: int) -> DataFrame:
    """``value``, ``timestamp`` and ``message_id``: a name for each message that a replay of the batch gives again. Equal
    messages of one batch are numbered; which of them has which number does not matter."""
    name = F.md5(F.concat_ws(":", F.lit(str(batch_id)), F.col("value"), F.col("timestamp").cast("string")))
    each = Window.partitionBy("_name").orderBy(F.lit(0))
    return (batch.select(F.col("value").cast("string").alias("value"), "timestamp").withColumn("_name", name)
            .withColumn("message_id", F.concat_ws("-", "_name", F.row_number().over(each).cast("string"))).drop("_name"))


def write_together(df: DataFrame, sinks: list, manifest: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write every micro-batch of ``df`` (``value``, ``timestamp``) to all ``sinks``, functions of (messages, batch id), and
    then list it in ``manifest``; a batch in the manifest is skipped when it comes again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry = f"{manifest}/batch_id={batch_id}"
        if path_exists(spark, f"{entry}/_SUCCESS"):
            return
        msgs = message_ids(batch, batch_id).persist()
        for sink in sinks:
            sink(msgs, batch_id)
        msgs.agg(F.count(F.lit(1)).alias("messages")).write.mode("overwrite").parquet(entry)
        msgs.unpersist()

    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def committed(spark: SparkSession, path: str, manifest: str, fmt: str = "parquet") -> DataFrame:
    """The rows below ``path`` (``batch_id=<id>`` folders) of the batches that ``manifest`` lists."""
    done = spark.read.parquet(manifest).select("batch_id").distinct()
    return spark.read.format(fmt).load(path).join(done, "batch_id", "left_semi")


def upsert_run(df: DataFrame, keys: list[str], path: str, checkpoint: str,
               state_partitions: int | None = None) -> DataFrame:
    """Run an aggregating stream in ``update`` mode to completion (available-now) and
    return the latest row per key. Each batch's updates are written under
    ``batch_id=<id>`` (replays overwrite), the final view is ``max_by`` over batch id.

    Streaming state is partitioned by ``spark.sql.shuffle.partitions`` when the
    query first starts (AQE does not resize it), so the state partition count
    is set explicitly for the start of a new query: ``state_partitions`` or the
    cluster's default parallelism; the session value is restored afterwards.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))

    with state_partitioning(df.sparkSession, state_partitions):
        q = (df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    q.awaitTermination()
    out = df.sparkSession.read.parquet(path)
    cols = [c for c in out.columns if c not in keys and c != "batch_id"]
    latest = out.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_r"))
    return latest.select(*keys, "_r.*")


def file_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table as a stream of its files: ``path`` is a folder, whose new files follow, or one file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - Hadoop's file system
    status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)  # noqa: SLF001
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if status.isDirectory():
        return r.parquet(path)
    # a file source watches folders, so one file is its folder with all other names left out
    return r.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def wait_until(cond, timeout: float = 60.0, step: float = 0.5) -> bool:
    end = time.time() + timeout
    while time.time() < end:
        if cond():
            return True
        time.sleep(step)
    return False


def event_time(col: Column | str) -> Column:
    return F.to_timestamp(col)
