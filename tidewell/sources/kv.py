"""Key/value state as a table (A26): last write wins per key.

Writes are rows ``(key, value, ts, seq)``; nested values are stored as JSON
text. The current value of every key is one aggregate, ``max_by`` over
``(ts, seq)``, so a hot key is reduced map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_value(c: Column, dtype) -> Column:
    """Scalars are stored as text; structs, maps and arrays as JSON."""
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(c)
    return c.cast("string")


def latest(writes: DataFrame, key: str = "key", value: str = "value", ts: str = "ts", seq: str = "seq") -> DataFrame:
    return (writes.groupBy(key).agg(F.max_by(F.col(value), F.struct(F.col(ts), F.col(seq))).alias(value),
                                    F.max(ts).alias("updated_at")))


def get(state: DataFrame, key_value: str, key: str = "key") -> DataFrame:
    return state.filter(F.col(key) == key_value)
