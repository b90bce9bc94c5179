"""Audit log and topic reads.

The audit log is a table ``(id, event_type, user_id, topic_name,
topic_message, created_at)``; the topic is a table ``(topic, partition,
offset, value, timestamp)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_query(log: DataFrame, topic: str | None = None, user_id: str | None = None, offset: int = 0,
                limit: int = 50) -> DataFrame:
    """Optional topic/user filters, newest first (id breaks ties), total before paging.

    The total is ``count(*) over ()`` computed on the filtered rows; paging
    uses a global sort with ``offset``/``limit`` (a top-(offset+limit) per task
    before the final merge).
    """
    f = log
    if topic is not None:
        f = f.filter(F.col("topic_name") == topic)
    if user_id is not None:
        f = f.filter(F.col("user_id") == user_id)
    total = f.select(F.count(F.lit(1))).scalar()
    page = f.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    return page.withColumn("total", total)


def bounded_consume(topic_df: DataFrame, n: int) -> DataFrame:
    """Up to n (1..100) messages from the start of the topic, counting messages (not polls)."""
    if not 1 <= int(n) <= 100:
        raise ValueError(f"n must be between 1 and 100, not {n}")
    return topic_df.orderBy("partition", "offset").limit(n).select("topic", "partition", "offset", "value")


