"""Skew-safe per-entity operators equal plain windows; BFS reachability on cyclic graphs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators.graph import reachable
from tidewell.operators.timeseries import bucketed_lag, bucketed_range_count


def _events(spark):
    # one hot entity (half of the rows) plus many small ones, spread over several days
    return (spark.range(4000)
            .select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 37).alias("entity"),
                    F.col("id").alias("seq"),
                    F.timestamp_seconds(F.lit(1704067200) + (F.col("id") * 7919) % (5 * 86400)).alias("ts"),
                    (F.col("id") * 31 % 100).alias("level")))


def test_bucketed_lag_equals_window(spark):
    ev = _events(spark)
    got = bucketed_lag(ev, "entity", "ts", ["level", "seq"], tiebreak="seq", bucket_seconds=3600)
    w = Window.partitionBy("entity").orderBy("ts", "seq")
    want = ev.select("seq", F.lag("level").over(w).alias("prev_level"), F.lag("ts").over(w).alias("prev_ts"))
    a = sorted(map(tuple, got.select("seq", "prev_level", "prev_ts").collect()))
    b = sorted(map(tuple, want.collect()))
    assert a == b


def test_bucketed_range_count_equals_window(spark):
    ev = _events(spark)
    got = bucketed_range_count(ev, "entity", "ts", 1800, bucket_seconds=3600)
    w = (Window.partitionBy("entity").orderBy(F.unix_micros(F.col("ts")))
         .rangeBetween(-1800 * 1_000_000, 0))
    want = ev.select("seq", F.count(F.lit(1)).over(w).alias("recent"))
    assert sorted(map(tuple, got.select("seq", "recent").collect())) == sorted(map(tuple, want.collect()))


def test_reachable_shortest_depth_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 4), (4, 5)], "src long, dst long")
    starts = spark.createDataFrame([(1,)], "k long")
    got = {(r["node"], r["depth"]) for r in reachable(starts, "k", edges).collect()}
    assert got == {(2, 1), (4, 1), (3, 2), (5, 2)}
