"""Top-k with a deterministic order.

``orderBy(...).limit(k)`` is planned as TakeOrderedAndProject: every task
keeps only its own k best rows and the final merge sees k x tasks rows, so
no full sort and no shuffle of the input happen. The caller passes every
output column as a tie-break so ties at the border give a stable answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, order: list) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, k: int, group: list, order: list[Column], rank_col: str | None = None) -> DataFrame:
    """At most k rows per group (``row_number`` over the group), one shuffle on the group key."""
    w = Window.partitionBy(*group).orderBy(*order)
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return out if rank_col else out.drop(rn)
