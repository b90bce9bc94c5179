"""Streaming: generator run control, restart without duplicates, stream = batch, idempotent dual write."""

import os
import tempfile

from pyspark.sql import functions as F

from tidewell.plans import streams as ST
from tidewell.streaming import analytics as A
from tidewell.streaming import jobs as J

from .conftest import SF_SMALL


def _tmp():
    return tempfile.mkdtemp(prefix="tw-test-")


def test_generator_restart_has_no_duplicates(spark):
    out, ckpt = os.path.join(_tmp(), "out"), os.path.join(_tmp(), "ckpt")
    spec = ST.stream_spec("fraud_detection")
    q = J.generator(spark, spec, out, rows_per_batch=50, interval_seconds=0.1, checkpoint=ckpt)
    J.wait_until(lambda: len(q.recentProgress) >= 2, 60)
    first = J.run_for(q, 0.1)
    assert first["rows_produced"] >= 100
    q2 = J.generator(spark, spec, out, rows_per_batch=50, interval_seconds=0.1, checkpoint=ckpt)
    J.wait_until(lambda: len(q2.recentProgress) >= 2, 60)
    J.run_for(q2, 0.1)
    recs = J.decode(spark.read.text(out), "transaction_id string, amount decimal(10,2), event_timestamp string")
    n = recs.count()
    assert n >= 200 and recs.select("transaction_id").distinct().count() == n
    # records equal the batch form for the same ids
    batch_ids = ST.batch(spark, "fraud_detection", n).select("transaction_id")
    assert recs.select("transaction_id").subtract(batch_ids).count() == 0


def test_stream_equals_batch_for_windows(spark):
    src_dir = _tmp()
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    ev.repartition(4).write.mode("overwrite").parquet(os.path.join(src_dir, "ev"))
    stream = J.file_stream(spark, os.path.join(src_dir, "ev"), ev.schema, max_files_per_trigger=1)
    # files arrive out of time order here, so the watermark delay covers the whole span (no row is late)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "400 days")
    got = J.upsert_run(A.tumbling_error_rate(stream), ["window_start"], os.path.join(_tmp(), "o"),
                       os.path.join(_tmp(), "c"))
    want = A.tumbling_error_rate(ev.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_dual_write_is_idempotent_and_complete(spark):
    topic_in = _tmp()
    spark.range(30).select(F.to_json(F.struct(F.col("id").alias("k"))).alias("value")).write.mode(
        "overwrite").text(topic_in)
    src = J.topic_source(spark, "t1", folder=topic_in)
    topic_out, audit, ckpt = _tmp(), _tmp(), os.path.join(_tmp(), "c")
    J.dual_write(src, topic_out, audit, ckpt, "t1", "u1").awaitTermination()
    J.dual_write(J.topic_source(spark, "t1", folder=topic_in), topic_out, audit, ckpt, "t1", "u1").awaitTermination()
    assert spark.read.text(topic_out).count() == 30
    a = spark.read.parquet(audit)
    assert a.count() == 30 and a.select("topic_message").distinct().count() == 30


def test_dead_letters_split(spark):
    recs = spark.createDataFrame([('{"k": 1}',), ("not json",), ('{"k": 2}',)], "value string")
    good, dead = A.split_dead_letters(recs, "k INT")
    assert sorted(r["k"] for r in good.collect()) == [1, 2]
    assert [r["raw"] for r in dead.collect()] == ["not json"]


def test_late_rows_dropped_by_watermark(spark):
    d = _tmp()
    schema = "ts timestamp, event_type string"
    spark.createDataFrame([("2024-01-01 10:00:00", "view"), ("2024-01-01 12:00:00", "view")], "t string, e string") \
        .select(F.to_timestamp("t").alias("ts"), F.col("e").alias("event_type")).write.mode("append").parquet(d)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d).withWatermark("ts", "10 minutes")
    agg = stream.groupBy(F.window("ts", "5 minutes")).count()
    ckpt = os.path.join(_tmp(), "c")
    out = _tmp()

    def write(b, i):
        b.write.mode("append").parquet(out)

    q = agg.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", ckpt) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    # a late row (older than the watermark) arrives in a new file
    spark.createDataFrame([("2024-01-01 09:00:00", "view")], "t string, e string") \
        .select(F.to_timestamp("t").alias("ts"), F.col("e").alias("event_type")).write.mode("append").parquet(d)
    q = agg.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", ckpt) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum((p.get("stateOperators") or [{}])[0].get("numRowsDroppedByWatermark", 0) for p in q.recentProgress)
    assert dropped >= 1


def _events_folder(spark):
    d = os.path.join(_tmp(), "ev")
    spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).write.mode("overwrite").parquet(d)
    return d


def test_stream_to_table_and_preview(spark):
    src_dir = _events_folder(spark)
    schema = spark.read.parquet(src_dir).schema
    out, ckpt = os.path.join(_tmp(), "t"), os.path.join(_tmp(), "c")
    J.to_table(J.file_stream(spark, src_dir, schema), out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == spark.read.parquet(src_dir).count()
    q = J.preview(J.file_stream(spark, src_dir, schema).select("event_id"), "tw_preview")
    q.processAllAvailable()
    assert spark.table("global_temp.tw_preview").count() == min(1000, spark.read.parquet(src_dir).count())
    q.stop()
    q = J.preview(J.file_stream(spark, src_dir, schema).select("event_id"), "tw_preview", rows=7)
    q.processAllAvailable()
    n = spark.table("global_temp.tw_preview").count()
    q.stop()
    assert n == 7


def test_stream_dedupe_and_enrichment(spark):
    src_dir = _events_folder(spark)
    ev = spark.read.parquet(src_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    doubled = os.path.join(_tmp(), "dup")
    ev.unionByName(ev).write.mode("overwrite").parquet(doubled)
    stream = J.file_stream(spark, doubled, ev.schema)
    dedup = A.dedupe(stream, ["event_id"], ts="ts", watermark="1 day")
    cust = spark.read.parquet(os.path.join(SF_SMALL, "customer.parquet"))
    enriched = A.enrich(dedup, cust, "user_id", "c_custkey").select("event_id", "c_mktsegment")
    out, ckpt = os.path.join(_tmp(), "o"), os.path.join(_tmp(), "c")
    J.to_table(enriched, out, ckpt).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == ev.count() == got.select("event_id").distinct().count()


def test_stream_of_a_table_stored_as_a_folder(spark, tmp_path):
    from tidewell.plans.stream_analytics_queries import j2_error_rate, j2_stream_error_rate
    from tidewell.sources.fixtures import Tables, read
    read(spark, SF_SMALL, "events").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    t = Tables(spark, str(tmp_path))
    assert sorted(map(str, j2_stream_error_rate(t).collect())) == sorted(map(str, j2_error_rate(t).collect()))


def test_funnel_takes_the_first_step_after_the_one_before(spark):
    from tidewell.streaming.analytics import funnel
    rows = [("a", 1, "click"), ("a", 2, "view"), ("a", 3, "click"), ("a", 4, "purchase"), ("b", 1, "view"), ("b", 0, "click"), ("c", 5, "purchase")]
    df = spark.createDataFrame(rows, "u string, t int, s string")
    assert tuple(funnel(df, "u", "t", "s", ["view", "click", "purchase"]).first()) == (2, 1, 1)


def test_rows_produced_counts_every_batch(spark, tmp_path):
    import pytest

    from tidewell.streaming import jobs as J
    spec = [{"name": "v", "type": "int", "min": 0, "max": 9, "random": True}]
    with pytest.raises(ValueError):
        J.generator(spark, spec, str(tmp_path / "x"), interval_seconds=0.01)
    q = J.generator(spark, spec, str(tmp_path / "out"), rows_per_batch=20, interval_seconds=0.1, checkpoint=str(tmp_path / "c"))
    got = J.run_for(q, 8)
    assert got["rows_produced"] == spark.read.text(str(tmp_path / "out")).count() > 0


def test_dead_letters_go_to_their_own_table(spark, tmp_path):
    spark.createDataFrame([('{"a": 1}',), ("{broken",), ('{"a": 2}',)], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    src = J.topic_source(spark, "t", folder=str(tmp_path / "in"))
    A.write_split(src.select("value"), "a INT", str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r["a"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 2]
    assert [r["raw"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["{broken"]


def test_dual_write_shows_a_batch_in_both_sinks_or_in_none(spark, tmp_path):
    import pytest
    spark.range(12).select((F.col("id") % 10).cast("string").alias("value")).coalesce(1).write.text(str(tmp_path / "in"))
    src = lambda: J.topic_source(spark, "t", folder=str(tmp_path / "in")).select("value", "timestamp")
    manifest = J.manifest_path(str(tmp_path / "audit"))
    sent, fail = [], [True]

    def topic(msgs, batch_id):  # like a topic that keeps what it got: a replay sends again, under the same ids
        sent.append(sorted(r["message_id"] for r in msgs.collect()))
        msgs.select("value").write.mode("append").text(str(tmp_path / "topic" / f"batch_id={batch_id}"))

    def audit(msgs, batch_id):
        if fail[0]:
            raise RuntimeError("killed between the sinks")
        msgs.write.mode("overwrite").parquet(str(tmp_path / "audit" / f"batch_id={batch_id}"))

    q = J.write_together(src(), [topic, audit], manifest, str(tmp_path / "c"))
    with pytest.raises(Exception, match="killed between"):
        q.awaitTermination()
    assert not (tmp_path / "audit" / "_commits").exists()  # nothing is visible yet
    fail[0] = False
    J.write_together(src(), [topic, audit], manifest, str(tmp_path / "c")).awaitTermination()
    assert len(sent) == 2 and sent[0] == sent[1] and len(set(sent[0])) == 12
    seen = J.committed(spark, str(tmp_path / "audit"), manifest)
    assert seen.count() == seen.select("message_id").distinct().count() == 12
    # a batch in the manifest is not written again
    J.write_together(src(), [topic, audit], manifest, str(tmp_path / "c2")).awaitTermination()
    assert len(sent) == 2


def test_runs_are_listed_counted_and_stopped(spark, tmp_path):
    import pytest

    from tidewell.streaming.runs import RunRegistry, committed_offset
    runs = RunRegistry(spark)
    spec = [{"name": "v", "type": "int", "min": 0, "max": 9, "random": True}]
    c = str(tmp_path / "c")
    a = runs.start("fast", lambda: J.generator(spark, spec, str(tmp_path / "a"), rows_per_batch=3, interval_seconds=0.1, checkpoint=c), c)
    spark.range(40).select(F.col("id").cast("string").alias("value")).coalesce(4).write.text(str(tmp_path / "in"))
    b = runs.start("copy", lambda: J.to_table(J.topic_source(spark, "t", folder=str(tmp_path / "in"), max_files_per_trigger=1).select("value"),
                                              str(tmp_path / "b"), str(tmp_path / "cb")))
    with pytest.raises(ValueError):
        runs.start("fast", lambda: None)
    assert runs.wait(b)["status"] == "completed" and runs.status(b)["rows_produced"] == 40
    assert [(r["name"], r["status"]) for r in runs.list()] == [("fast", "running"), ("copy", "completed")]
    assert J.wait_until(lambda: runs.status(a)["batches"] >= 150, 200)
    end = runs.stop(a)
    batch, offset = committed_offset(spark, c)
    rows = spark.read.text(str(tmp_path / "a")).count()
    # more batches than a query's own progress list keeps
    assert end["status"] == "stopped" and end["batches"] >= 150 and rows == offset["offset"] == 3 * (batch + 1)
    assert abs(end["rows_produced"] - rows) <= 3  # a stop may fall between the commit and its event
    assert runs.status("nobody")["status"] == "not_found" and committed_offset(spark, str(tmp_path / "none")) == (-1, None)

    def broken():
        return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load().select(F.raise_error(F.lit("no"))).writeStream.format("noop").option(
            "checkpointLocation", str(tmp_path / "cx")).start()
    x = runs.start("fast", broken)
    try:
        runs.wait(x)
    except Exception:  # noqa: BLE001 - the query's own error
        pass
    assert J.wait_until(lambda: runs.status(x)["status"] == "error", 30) and runs.status(x)["error"]
    runs.close()
