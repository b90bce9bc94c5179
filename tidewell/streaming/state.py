"""Streaming operators whose result depends on an entity's order of events.

* ``stream_lag``      the previous event of an entity, from keyed state: events
                      wait in the state until the watermark has passed them,
                      so they are taken in event-time order however the files
                      or micro-batches cut them; a timer lets out what waits
                      and forgets entities that stay silent
* ``interval_count``  the number of an entity's events in the time before each
                      of its events, from keyed state: the key is a hash of
                      (entity, time bucket), so that a busy entity is spread
                      over its buckets and many quiet ones share one state;
                      events are counted by their places in a sorted order,
                      never in pairs

Both drop events later than the watermark, and keep state no longer than the
watermark delay plus the window or the idle time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _millis(spark_interval: str, df: DataFrame) -> int:
    return df.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL '{spark_interval}') AS m").first()["m"]


def _whole_millis(ts: str) -> Column:
    """Event time rounded up to milliseconds, in which watermarks are kept: what the watermark reaches, it has passed."""
    return F.timestamp_millis(F.ceil(F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("long"))


def plain(values: pd.Series) -> list:
    """The values as Python objects, None for what is missing."""
    out = values.tolist()
    if values.dtype.kind in "iub":
        return out
    missing = values.isna().to_numpy()
    return [None if m else v for v, m in zip(out, missing)] if missing.any() else out


def objects(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """The rows as one block of objects, whose types pandas does not look for."""
    block = np.empty((len(rows), len(names)), dtype=object)
    for i, column in enumerate(zip(*rows)):
        block[:, i] = np.fromiter(column, dtype=object, count=len(rows))
    return pd.DataFrame(block, columns=names, copy=False)


def stream_lag(df: DataFrame, entity: str, ts: str, cols: list[str], tiebreak: str, delay: str = "10 minutes",
               idle: str = "30 days", prefix: str = "prev_") -> DataFrame:
    """``entity, ts, tiebreak``, the columns ``cols`` and ``prev_`` + each of ts and ``cols``: the entity's previous event
    by (ts, tiebreak), null for its first.

    State for each entity: its last event, and the events the watermark has not passed. It is dropped ``idle`` of event
    time after the last event; an event after that counts as a first one.
    """
    names = [tiebreak, *[c for c in cols if c != tiebreak]]
    kept = [T.StructField("_t", T.LongType()), *[df.schema[c] for c in names]]
    idle_ms = _millis(idle, df)
    state_type = T.StructType([*[T.StructField(f"last_{f.name}", f.dataType) for f in kept],
                               *[T.StructField(f"wait_{f.name}", T.ArrayType(f.dataType)) for f in kept]])
    out_type = T.StructType([df.schema[entity], *kept, *[T.StructField(prefix + f.name, f.dataType) for f in kept]])
    n = len(kept)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None,) * n + ([],) * n
        last = held[:n] if held[0] is not None else None
        waiting = list(zip(*held[n:]))
        if not state.hasTimedOut:
            for b in batches:
                waiting += zip(*(plain(b[f.name]) for f in kept))
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
        at = sum(r[0] <= mark for r in waiting)
        rows = []
        for r in waiting[:at]:
            if last is not None and r[0] - last[0] > idle_ms * 1000:
                last = None
            rows.append((*key, *r, *(last or (None,) * n)))
            last = r
        waiting = waiting[at:]
        # the next moment at which something is to be done: the first that waits, or the end of the idle time
        due = waiting[0][0] // 1000 if waiting else last[0] // 1000 + idle_ms if last else 0
        if not waiting and (last is None or due <= mark // 1000):
            state.remove()
        else:
            state.update(tuple(last or (None,) * n) + tuple(list(c) for c in (zip(*waiting) if waiting else [()] * n)))
            state.setTimeoutTimestamp(max(due, mark // 1000 + 1))
        if rows:
            yield objects(rows, out_type.names)

    events = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).select(entity, _whole_millis(ts).alias("_w"), "_t", *names).withWatermark("_w", delay)
    out = events.groupBy(entity).applyInPandasWithState(step, out_type, state_type, "append", GroupStateTimeout.EventTimeTimeout)
    times = {c: F.timestamp_micros(F.col(c)).cast(df.schema[ts].dataType) for c in ("_t", prefix + "_t")}
    return out.select(entity, times["_t"].alias(ts), *names, times[prefix + "_t"].alias(prefix + ts), *[prefix + c for c in names])


def _filled(col: Column, dtype: T.DataType) -> Column:
    """A number in place of a missing one, as pandas has no missing integers; the caller keeps which were missing."""
    return F.coalesce(col, F.lit(0).cast(dtype)) if isinstance(dtype, (T.IntegralType, T.FractionalType)) else col


def packed(frame: pd.DataFrame) -> bytes:
    sink, table = pa.BufferOutputStream(), pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _codes(values: pd.Series, missing: pd.Series) -> np.ndarray:
    """Equal numbers for equal values; a missing one is a value of its own."""
    return pd.factorize(values, use_na_sentinel=False)[0].astype(np.int64) * 2 + missing.to_numpy()


def recent_counts(x: pd.DataFrame, due: np.ndarray, width: int) -> pd.DataFrame:
    """``_e, _en, _t, _k, _kn, _n``: for the rows ``due`` the number of rows of the same (_b, _e) with a time in
    [_t - width, _t]; equal events (_e, _t, _k) are one row with the counts of all of them."""
    bucket = pd.factorize(x["_b"])[0].astype(np.int64)
    group = _codes(x["_e"], x["_en"]) * (bucket.max() + 1) + bucket
    t, out = x["_t"].to_numpy(), x.loc[due, ["_e", "_en", "_t", "_k", "_kn"]].reset_index(drop=True)
    # rows and both ends of every interval in one order; what lies between the ends is what was passed in between
    start, row, end = (np.full(k, i, np.int8) for i, k in enumerate((len(out), len(x), len(out))))
    kind = np.concatenate([start, row, end])
    order = np.lexsort((kind, np.concatenate([t[due] - width, t, t[due]]), np.concatenate([group[due], group, group[due]])))
    passed = np.empty(len(kind), np.int64)
    passed[order] = np.cumsum(kind[order] == 1)
    out["_n"] = passed[len(out) + len(x):] - passed[:len(out)]
    same = pd.DataFrame({"g": group[due], "t": t[due], "k": _codes(out["_k"], out["_kn"])})
    if same.duplicated().any():
        out["_n"] = out["_n"].groupby([same["g"], same["t"], same["k"]]).transform("sum")
        out = out[~same.duplicated()]
    return out


def interval_count(df: DataFrame, entity: str, ts: str, key: str, window_seconds: int, delay: str = "10 minutes",
                   name: str = "recent", shards: int = 1024) -> DataFrame:
    """``entity, ts, key, name``: for each event (``key`` tells events apart) the number of the entity's events with a time
    in [ts - window, ts], itself included.

    Events are kept in ``shards`` states, dealt out by a hash of (entity, bucket of eight windows); those of a bucket's
    last window go to the next bucket as well. A state has the events that the watermark has not passed and those of the
    window before it. ``shards`` may not change between runs of one checkpoint.
    """
    width = int(window_seconds) * 1_000_000
    span = 8 * width
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    kinds = {c: df.schema[c].dataType for c in (entity, key)}
    names = ["_b", "_own", "_t", "_e", "_en", "_k", "_kn"]
    out_type = T.StructType([T.StructField(entity, kinds[entity]), T.StructField("_t", T.LongType()), T.StructField(key, kinds[key]), T.StructField(name, T.LongType())])

    def step(shard: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [unpacked(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            parts += [b[names] for b in batches]
        x = pd.concat(parts, ignore_index=True)
        mark = state.getCurrentWatermarkMs() * 1000
        due = (x["_own"] & (x["_t"] <= mark)).to_numpy()
        found = recent_counts(x, due, width) if due.any() else None
        # what was counted stays for those after it
        x["_own"] &= ~due
        x = x[x["_own"] | ((x["_t"] > mark - width) & (x["_b"] + span > mark))]
        if x.empty:
            state.remove()
        else:
            state.update((packed(x),))
            waiting = x.loc[x["_own"], "_t"]
            # a timer runs when the watermark is beyond it: that of the first that waits, or of the last to be forgotten
            at = -(-int(waiting.min()) // 1000) - 1 if len(waiting) else -(-int(np.minimum(x["_t"] + width, x["_b"] + span).max()) // 1000)
            state.setTimeoutTimestamp(max(at, mark // 1000, 1))
        if found is not None:
            value = {c: found[v].astype(object).where(~found[m], None) if found[m].any() else found[v] for c, v, m in ((entity, "_e", "_en"), (key, "_k", "_kn"))}
            yield pd.DataFrame({entity: value[entity], "_t": found["_t"], key: value[key], name: found["_n"]})

    bucket = micros - F.pmod(micros, F.lit(span))
    of = F.array(F.struct(bucket.alias("_b"), F.lit(True).alias("_own")))
    also = F.concat(of, F.array(F.struct((bucket + F.lit(span)).alias("_b"), F.lit(False).alias("_own"))))
    events = (df.filter(F.col(ts).isNotNull())
              .select(_whole_millis(ts).alias("_w"), micros.alias("_t"), _filled(F.col(entity), kinds[entity]).alias("_e"), F.col(entity).isNull().alias("_en"),
                      _filled(F.col(key), kinds[key]).alias("_k"), F.col(key).isNull().alias("_kn"),
                      F.explode(F.when(micros - bucket >= span - width, also).otherwise(of)).alias("_p"))
              .withWatermark("_w", delay).select("_w", "_p._b", "_p._own", *names[2:], F.pmod(F.hash("_e", "_en", "_p._b"), F.lit(shards)).alias("_s")))
    out = events.groupBy("_s").applyInPandasWithState(step, out_type, "packed binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(entity, F.timestamp_micros("_t").alias(ts), key, name)
