"""Pattern queries over the fixture tables seen as a property graph (the ``T`` form of §2.H).

Nodes: Region, Nation, Customer, Supplier, Part, Order (one table each).
Relationships come from foreign-key columns: IN_REGION (nation -> region),
IN_NATION (customer/supplier -> nation), PLACED (customer -> order) and the
line items as relationships ORDERED (order -> part) and SHIPPED_BY
(order -> supplier) carrying quantity and price. The same ``hop`` operator
as for the generated graphs does the matching.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph, hop
from ..operators.topk import top_k
from ..sources.fixtures import Tables


def fixture_graph(t: Tables) -> Graph:
    g = Graph()
    g.add_nodes("Region", t.region, "r_regionkey").add_nodes("Nation", t.nation, "n_nationkey")
    g.add_nodes("Customer", t.customer, "c_custkey").add_nodes("Supplier", t.supplier, "s_suppkey")
    g.add_nodes("Part", t.part, "p_partkey").add_nodes("Order", t.orders, "o_orderkey")
    g.add_edges("IN_REGION", "Nation", "Region", t.nation.select(F.col("n_nationkey").alias("src"),
                                                                 F.col("n_regionkey").alias("dst")))
    g.add_edges("IN_NATION", "Customer", "Nation", t.customer.select(F.col("c_custkey").alias("src"),
                                                                     F.col("c_nationkey").alias("dst")))
    g.add_edges("IN_NATION", "Supplier", "Nation", t.supplier.select(F.col("s_suppkey").alias("src"),
                                                                     F.col("s_nationkey").alias("dst")))
    g.add_edges("PLACED", "Customer", "Order", t.orders.select(F.col("o_custkey").alias("src"),
                                                               F.col("o_orderkey").alias("dst")))
    li = t.lineitem
    g.add_edges("ORDERED", "Order", "Part", li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"),
                                                      "l_quantity", "l_extendedprice", "l_suppkey"))
    g.add_edges("SHIPPED_BY", "Order", "Supplier", li.select(F.col("l_orderkey").alias("src"),
                                                             F.col("l_suppkey").alias("dst"),
                                                             "l_linenumber", "l_extendedprice"))
    return g


def t_h1_region_customers(t: Tables) -> DataFrame:
    """(o:Order)<-[:PLACED]-(c)-[:IN_NATION]->(n)-[:IN_REGION]->(r): distinct customers and orders per region."""
    g = fixture_graph(t)
    x = g.rel("PLACED").select(F.col("src").alias("c_custkey"), F.col("dst").alias("o_orderkey"))
    x = hop(x, "c_custkey", g.rel("IN_NATION", "Customer"), out_key="n_nationkey")
    x = hop(x, "n_nationkey", g.rel("IN_REGION"), g.node("Region"), "r_regionkey", target_cols={"r_name": "region"})
    return (x.groupBy("region").agg(F.count_distinct("c_custkey").alias("customers"), F.count("*").alias("orders"))
            .orderBy(F.desc("customers"), "region"))


def t_h4_region_supplier_trace(t: Tables, k: int = 25) -> DataFrame:
    """(r)<-[:IN_REGION]-(n)<-[:IN_NATION]-(s)<-[sh:SHIPPED_BY]-(o): top k by line price."""
    g = fixture_graph(t)
    r = g.node("Region").select("r_regionkey", F.col("r_name").alias("region"))
    x = hop(r, "r_regionkey", g.rel("IN_REGION"), g.node("Nation"), "n_nationkey", direction="in",
            target_cols={"n_name": "nation"})
    x = hop(x, "n_nationkey", g.rel("IN_NATION", "Supplier"), g.node("Supplier"), "s_suppkey", direction="in",
            target_cols={"s_name": "supplier"})
    x = hop(x, "s_suppkey", g.rel("SHIPPED_BY"), direction="in", out_key="o_orderkey",
            edge_props={"l_linenumber": "linenumber", "l_extendedprice": "price"})
    out = x.select("region", "nation", "supplier", "o_orderkey", "linenumber", "price")
    return top_k(out, k, [F.desc("price"), "o_orderkey", "linenumber", "supplier", "nation", "region"])


def t_h10_supplier_revenue(t: Tables, k: int = 20) -> DataFrame:
    """(o)-[sh:SHIPPED_BY]->(s): count and rounded revenue per supplier, top k."""
    g = fixture_graph(t)
    x = hop(g.rel("SHIPPED_BY").select(F.col("src").alias("o_orderkey"), F.col("dst").alias("s_suppkey"),
                                       "l_extendedprice"),
            "s_suppkey", g.rel("IN_NATION", "Supplier"), g.node("Nation"), "n_nationkey",
            target_cols={"n_name": "nation"})
    x = x.join(g.node("Supplier").select("s_suppkey", F.col("s_name").alias("supplier")), "s_suppkey")
    out = (x.groupBy("supplier", "nation").agg(F.count("*").alias("lines"),
                                               F.round(F.sum("l_extendedprice"), 0).alias("revenue")))
    return top_k(out, k, [F.desc("revenue"), "supplier", "nation"])


def t_h12_multi_priority_customers(t: Tables, k: int = 20) -> DataFrame:
    """(c)-[:PLACED]->(o): customers whose orders span more than one priority (collect, HAVING size > 1)."""
    g = fixture_graph(t)
    x = hop(g.node("Customer").select("c_custkey", "c_mktsegment"), "c_custkey", g.rel("PLACED"), g.node("Order"),
            "o_orderkey", target_cols={"o_orderpriority": "priority"})
    per = (x.groupBy("c_custkey", "c_mktsegment").agg(F.array_sort(F.collect_set("priority")).alias("p"),
                                                      F.count("*").alias("orders"))
           .filter(F.size("p") > 1))
    out = per.select("c_custkey", "c_mktsegment", "orders", F.size("p").alias("n_priorities"),
                     F.array_join("p", ",").alias("priorities"))
    return top_k(out, k, [F.desc("n_priorities"), F.desc("orders"), "c_custkey"])


def t_h18_supplier_part_orders(t: Tables, k: int = 25) -> DataFrame:
    """(s)<-[sh:SHIPPED_BY]-(o)-[od:ORDERED]->(p) through the same line: both edge properties, top k."""
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("supplier"))
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("part"),
                      F.col("p_type").alias("part_type"))
    out = li.join(s, "l_suppkey").join(p, "l_partkey").select(
        "supplier", "part", "part_type", F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return top_k(out, k, [F.desc("quantity"), F.desc("price"), "order_key", "line", "supplier", "part"])


def t_h20_returned_then_reordered(t: Tables) -> DataFrame:
    """H20's pattern: one (customer, part) twice, a returned line first, an order of a later date second."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag").join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("day")), "l_orderkey")
    first = lines.filter(F.col("l_returnflag") == "R").select("customer", "l_partkey", F.col("day").alias("returned_order"))
    later = lines.select("customer", "l_partkey", F.col("day").alias("later_order"), F.col("l_returnflag").alias("later_flag"))
    return (first.join(later, ["customer", "l_partkey"]).filter(F.col("later_order") > F.col("returned_order"))
            .select("customer", F.col("l_partkey").alias("part"), "returned_order", "later_order", "later_flag"))


def t_h31_shared_parts(t: Tables, min_shared: int = 3) -> DataFrame:
    """H31's pattern: customers who ordered ``min_shared`` or more of the parts that one customer ordered, the customer of
    the most different parts (least key on ties)."""
    g = fixture_graph(t)
    has = (g.rel("PLACED").select(F.col("src").alias("customer"), F.col("dst").alias("src"))
           .join(g.rel("ORDERED").select("src", F.col("dst").alias("part")), "src").select("customer", "part").distinct())
    one = has.groupBy("customer").count().agg(F.max_by("customer", F.struct("count", -F.col("customer")))).scalar()
    mine = has.filter(F.col("customer") == one).select("part")
    return (has.join(mine, "part").filter(F.col("customer") != one).groupBy("customer").agg(F.count(F.lit(1)).alias("shared_parts"))
            .filter(F.col("shared_parts") >= min_shared))
