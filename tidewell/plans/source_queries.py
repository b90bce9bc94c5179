"""§2.A sources, sinks and table operations exercised on the fixture tables."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..operators.edges import k_targets
from ..session import scratch_path
from ..sources import audit as AU
from ..sources import kv as KV
from ..sources import tables as TB
from ..sources.fixtures import TABLES, Tables, register_views, table_path
from ..sources.graph_store import EdgeStore
from .datasets import SPECS, build_table, create_statement, rows

#: Tables that ``e_table_defaults`` fills at a time.
AT_A_TIME = 6


def a8_upsert_customers(t: Tables) -> DataFrame:
    """Customers with an order in 1998 are upserted with a new segment; the rest keep theirs."""
    target = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    active = t.orders.filter(F.year("o_orderdate") == 1998).select(F.col("o_custkey").alias("c_custkey")).distinct()
    updates = active.join(target, "c_custkey").select("c_custkey", "c_name",
                                                      F.lit("ACTIVE_1998").alias("c_mktsegment"))
    merged = TB.upsert(target, updates, ["c_custkey"])
    return merged.groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


def a11_table_copy(t: Tables) -> DataFrame:
    """Copy a filtered table (count observed during the write), then read the copy back."""
    path = scratch_path(t.spark, f"copy-{uuid.uuid4().hex[:8]}")
    n = TB.copy_table(t.lineitem.filter(F.col("l_returnflag") == "R"), path)
    back = TB.read_table(t.spark, path)
    return back.groupBy("l_linestatus").agg(F.count("*").alias("rows")).withColumn("copied", F.lit(n).cast("bigint"))


def a14_inventory(t: Tables) -> DataFrame:
    """Row count per table name; a missing name reports ``not found``."""
    names = {n: table_path(t.sf_dir, n) for n in TABLES}
    names["missing_table"] = table_path(t.sf_dir, "missing_table")
    return TB.inventory(t.spark, names)


def a20_describe_orders(t: Tables) -> DataFrame:
    return TB.describe(t.orders)


def a21_sample_rows(t: Tables) -> DataFrame:
    return TB.sample_rows(t.orders, 5, order_by=["o_orderkey"])


def _audit_log(t: Tables) -> DataFrame:
    e = t.events
    return e.select(F.col("event_id").alias("id"), "event_type", F.col("user_id").cast("string").alias("user_id"),
                    F.concat(F.lit("events."), F.col("event_type")).alias("topic_name"),
                    F.col("props").alias("topic_message"), F.col("ts").alias("created_at"))


def a24_audit_query(t: Tables) -> DataFrame:
    return AU.audit_query(_audit_log(t), topic="events.click", offset=40, limit=20)


def a25_bounded_consume(t: Tables) -> DataFrame:
    topic = t.events.select(F.lit("events").alias("topic"), F.pmod(F.col("user_id"), F.lit(4)).alias("partition"),
                            F.col("event_id").alias("offset"), F.col("props").alias("value"))
    return AU.bounded_consume(topic, 25)


def a26_latest_value_per_key(t: Tables) -> DataFrame:
    writes = t.events.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
                             KV.encode_value(F.col("props"), t.events.schema["props"].dataType).alias("value"),
                             F.col("ts"), F.col("event_id").alias("seq"))
    return KV.latest(writes)


FEDERATED_SQL = """
SELECT n_name, count(*) AS customers, round(avg(c_acctbal), 2) AS avg_balance
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_acctbal > 0 GROUP BY n_name
"""


def a27_federated_sql(t: Tables) -> DataFrame:
    """Tables registered as views (JDBC tables go through ``sources.jdbc.register_views``)."""
    register_views(t.spark, t.sf_dir, ["customer", "nation"])
    return t.spark.sql(FEDERATED_SQL)


def e_table_defaults(t: Tables) -> DataFrame:
    """E1-E6 as tables with column defaults: each of the 17 is created from DDL text, filled from its generator without
    ``created_at``, and described; one row for each column that has a default. The tables do not depend on each other, so
    they are filled several at a time: one of them may have too few file parts to keep all cores busy."""
    run = uuid.uuid4().hex[:8]

    def fill(table: str) -> DataFrame:
        name = f"tidewell_{table}_{run}"
        TB.create_from_ddl(t.spark, create_statement(table, name, scratch_path(t.spark, f"e-{run}/{table}")), name)
        TB.insert_with_defaults(build_table(t, table), name)
        df = t.spark.table(name)
        filled = df.select(F.count("created_at")).scalar()
        return (TB.describe(df).filter(F.col("column_default").isNotNull())
                .select(F.lit(table).alias("table_name"), "column_name", "column_default", "position", "row_count", filled.alias("filled")))

    with ThreadPoolExecutor(AT_A_TIME) as pool:
        parts = list(pool.map(inheritable_thread_target(t.spark)(fill), SPECS))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


TEXT_COLUMNS = {"budget_transactions": "description", "service_requests": "description", "k12_events": "details", "contracts": "title",
                "case_events": "county"}


def e_text_columns(t: Tables) -> DataFrame:
    """The descriptive columns of E2-E6: rows, distinct values, least and greatest value and total length of each."""
    parts = [build_table(t, table).agg(F.count(c).alias("n"), F.count_distinct(c).alias("values"), F.min(c).alias("least"), F.max(c).alias("greatest"),
                                       F.sum(F.length(c)).alias("characters")).select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), "*")
             for table, c in TEXT_COLUMNS.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def f15_only_missing_edges(t: Tables) -> DataFrame:
    """enrolment edges populated in two runs, first for the students of even number, then for all: the second run adds
    edges of the others only. Sources and edges by the version that wrote them."""
    store = EdgeStore(t.spark, scratch_path(t.spark, f"edges-{uuid.uuid4().hex[:8]}"))
    students = t.customer.select(F.col("c_custkey").cast("bigint").alias("_ord"))

    def build(missing: DataFrame) -> DataFrame:
        return k_targets(missing, "_ord", rows(t.part), 2, 5, 42, "ENROLLED_IN").select("src", F.col("dst_ord").alias("dst"))

    store.populate(students.filter("_ord % 2 = 0"), "_ord", build)
    store.populate(students, "_ord", build)
    return store.edges().groupBy("version").agg(F.count_distinct("src").alias("sources"), F.count(F.lit(1)).alias("edges"), F.sum("dst").alias("targets"))
