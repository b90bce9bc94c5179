"""Relational analytics over the fixture tables (the ``T`` form of §2.G).

Each function is the reference's query shape (filter, group, the same
aggregates, the same sort) applied to a fixture table. All aggregates are
built-in hash aggregates with map-side partial aggregation, so the only
shuffle is of partial rows per group key; filters and the column lists reach
the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.topk import top_k
from ..sources.fixtures import Tables


def _r(c, n=4):
    return F.round(c.cast("double"), n)


def g1_orders_per_priority(t: Tables) -> DataFrame:
    """G1: filter on one status, count + distinct customers per priority."""
    return (t.orders.filter(F.col("o_orderstatus") == "F")
            .groupBy("o_orderpriority")
            .agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("unique_customers"))
            .orderBy("o_orderpriority"))


def g2_customers_by_segment_nation(t: Tables) -> DataFrame:
    """Two-key aggregate, ordered by count desc."""
    return (t.customer.groupBy("c_mktsegment", "c_nationkey")
            .agg(F.count("*").alias("customers"), _r(F.avg("c_acctbal")).alias("avg_acctbal"),
                 _r(F.max("c_acctbal")).alias("max_acctbal"))
            .orderBy(F.desc("customers"), "c_mktsegment", "c_nationkey"))


def g3_lineitem_by_status_year(t: Tables) -> DataFrame:
    """Filter one flag, count and sum per (status, ship year); year asc, sum desc."""
    return (t.lineitem.filter(F.col("l_returnflag") == "R")
            .groupBy("l_linestatus", F.year("l_shipdate").cast("int").alias("ship_year"))
            .agg(F.count("*").alias("lineitems"), _r(F.sum("l_extendedprice"), 2).alias("total_price"))
            .orderBy("ship_year", F.desc("total_price")))


def g4_order_status_shares(t: Tables) -> DataFrame:
    """Shares of boolean conditions as avg(cast(flag as int))."""
    o = t.orders
    return (o.groupBy("o_orderpriority")
            .agg(F.count("*").alias("orders"),
                 _r(F.avg((F.col("o_orderstatus") == "F").cast("int"))).alias("pct_finished"),
                 _r(F.avg((F.col("o_orderstatus") == "O").cast("int"))).alias("pct_open"),
                 _r(F.avg((F.col("o_orderstatus") == "P").cast("int"))).alias("pct_partial"),
                 _r(F.avg("o_totalprice"), 2).alias("avg_totalprice"))
            .orderBy(F.desc("orders"), "o_orderpriority"))


def g5_null_skipping_avg(t: Tables) -> DataFrame:
    """Averages that skip nulls (value only for purchases)."""
    e = t.events
    return (e.groupBy("event_type", F.hour("ts").cast("int").alias("hour"))
            .agg(F.count("*").alias("events"),
                 _r(F.avg(F.when(F.col("event_type") == "purchase", F.col("value")))).alias("avg_purchase_value"),
                 _r(F.avg("value")).alias("avg_value"))
            .orderBy(F.desc("events"), "event_type", "hour"))


def g7_big_orders_by_segment(t: Tables) -> DataFrame:
    """Filter, inner join using the key, group by two attributes of the dimension."""
    big = t.orders.filter(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return (big.join(t.customer, "c_custkey")
            .groupBy("c_mktsegment", "c_nationkey")
            .agg(F.count("*").alias("big_orders"), _r(F.avg("o_totalprice"), 2).alias("avg_totalprice"),
                 _r(F.avg("c_acctbal"), 2).alias("avg_acctbal"))
            .orderBy(F.desc("big_orders"), "c_mktsegment", "c_nationkey"))


def g9_parts_by_brand_type(t: Tables) -> DataFrame:
    """Count, sum, two averages, ordered by the sum."""
    return (t.part.groupBy("p_brand", "p_type")
            .agg(F.count("*").alias("parts"), _r(F.sum("p_retailprice"), 2).alias("total_value"),
                 _r(F.avg("p_retailprice")).alias("avg_value"), _r(F.avg("p_size")).alias("avg_size"))
            .orderBy(F.desc("total_value"), "p_brand", "p_type"))


def g15_customer_activity(t: Tables, k: int = 20) -> DataFrame:
    """Join orders to customers, group by customer attributes, top k by count."""
    agg = (t.orders.groupBy("o_custkey")  # pre-aggregate the fact side before the join
           .agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s")))
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal", "c_mktsegment")
    joined = (agg.join(c, "o_custkey")
              .groupBy("c_name", "c_acctbal", "c_mktsegment")
              .agg(F.sum("n").alias("orders"), _r(F.sum("s") / F.sum("n"), 2).alias("avg_order_value")))
    return top_k(joined, k, [F.desc("orders"), F.desc("avg_order_value"), "c_name", "c_acctbal", "c_mktsegment"])


def g16_risk_filter(t: Tables) -> DataFrame:
    """A single range filter; pushed into the parquet scan."""
    return t.orders.filter(F.col("o_totalprice") > 450000).select("o_orderkey", "o_custkey", "o_totalprice")


def g17_sum_across_statuses(t: Tables) -> DataFrame:
    """Total rows over a map of per-status counts."""
    per = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").cast("bigint").alias("total_rows"), F.count("*").alias("statuses"))
