"""Property graphs as named DataFrames, and pattern matching as joins.

A ``Graph`` holds one DataFrame per node label (with a declared key column)
and one DataFrame per relationship ``(type, from_label, to_label)`` with the
columns ``src, dst`` plus properties. A Cypher-style pattern becomes a chain
of equi-joins (``hop``); ``OPTIONAL MATCH`` becomes a left join of the whole
optional part; variable-length paths are a bounded, edge-unique frontier
expansion; connected components are an iterated min-label propagation.

Planning notes for scale: every hop is an equi-join on a key, so Spark picks a
broadcast hash join when one side is measured small (dimension nodes) and a
sort-merge join otherwise; AQE splits skewed join partitions. No operator
here builds a cross product or collects a group to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)
    edges: dict[tuple[str, str, str], DataFrame] = field(default_factory=dict)

    # Node and edge tables may be given as DataFrames or as zero-argument builders; a builder runs
    # on first use only, so a pattern plans just the tables it touches.
    def add_nodes(self, label: str, df, key: str) -> "Graph":
        self.nodes[label] = df
        self.keys[label] = key
        return self

    def add_edges(self, etype: str, src_label: str, dst_label: str, df) -> "Graph":
        self.edges[(etype, src_label, dst_label)] = df
        return self

    def node(self, label: str) -> DataFrame:
        v = self.nodes[label]
        if callable(v):
            v = self.nodes[label] = v()
        return v

    def edge_table(self, key: tuple[str, str, str]) -> DataFrame:
        v = self.edges[key]
        if callable(v):
            v = self.edges[key] = v()
        return v

    def rel(self, etype: str, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
        """Edges of one type (optionally restricted by end labels); union if several match."""
        found = [self.edge_table((t, s, d)) for (t, s, d) in list(self.edges)
                 if t == etype and (src_label in (None, s)) and (dst_label in (None, d))]
        if not found:
            raise KeyError(etype)
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    # --- A6 / A7 / A22 / F21 -------------------------------------------------
    def label_counts(self) -> DataFrame:
        """Node count per label (H14, F21), descending."""
        parts = [self.node(lbl).agg(F.count("*").alias("count")).select(F.lit(lbl).alias("label"), "count")
                 for lbl in list(self.nodes)]
        return _union_all(parts).orderBy(F.desc("count"), "label")

    def type_counts(self) -> DataFrame:
        """Relationship count per type (H14, F21), descending; types split by end labels are summed."""
        parts = [self.edge_table(k).agg(F.count("*").alias("count"))
                 .select(F.lit(k[0]).alias("relationship_type"), "count") for k in list(self.edges)]
        return (_union_all(parts).groupBy("relationship_type").agg(F.sum("count").alias("count"))
                .orderBy(F.desc("count"), "relationship_type"))

    def pattern_sample(self, limit: int = 100) -> DataFrame:
        """``MATCH (n)-[r]->(m) RETURN n, type(r), m LIMIT n`` over all typed edges.

        The first ``limit`` by (type, src, dst) are returned, so the sample is
        reproducible (a per-task top-k, not a scan of everything)."""
        parts = [self.edge_table((t, s, d)).select(
                     F.lit(s).alias("src_label"), F.col("src").cast("string").alias("src"), F.lit(t).alias("type"),
                     F.lit(d).alias("dst_label"), F.col("dst").cast("string").alias("dst"))
                 for (t, s, d) in list(self.edges)]
        return _union_all(parts).orderBy("type", "src", "dst", "src_label", "dst_label").limit(limit)

    def without_label(self, label: str) -> "Graph":
        """Drop a label and every relationship touching it (returns a new graph)."""
        g = Graph(dict(self.nodes), dict(self.keys), dict(self.edges))
        g.nodes.pop(label, None)
        g.keys.pop(label, None)
        for k in [k for k in g.edges if label in (k[1], k[2])]:
            g.edges.pop(k)
        return g


def clear_label(g: Graph, label: str) -> tuple[Graph, dict[str, int]]:
    """The graph without ``label`` and its relationships, and how many nodes and edges that removes."""
    gone = [g.edge_table(k) for k in list(g.edges) if label in (k[1], k[2])]
    counts = {"deleted_nodes": g.node(label).count() if label in g.nodes else 0,
              "deleted_edges": sum(e.count() for e in gone)}
    return g.without_label(label), counts


def _union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hop(left: DataFrame, left_key: str, edges: DataFrame, target: DataFrame | None = None,
        target_key: str | None = None, direction: str = "out", optional: bool = False,
        edge_props: dict[str, str] | None = None, target_cols: dict[str, str] | None = None,
        out_key: str | None = None) -> DataFrame:
    """One pattern step ``(left)-[e]->(target)`` (``direction="in"`` for ``<-[e]-``).

    ``edge_props`` / ``target_cols`` map source column -> output name. The new
    node's key is exposed as ``out_key`` (default: ``target_key``). With
    ``optional=True`` the edge and target are inner-joined first and the result
    is left-joined as one unit (OPTIONAL MATCH semantics: no partial rows).
    """
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    out_key = out_key or target_key or "dst_key"
    e = edges.select(F.col(near).alias("__near"), F.col(far).alias(out_key),
                     *[F.col(c).alias(a) for c, a in (edge_props or {}).items()])
    if target is not None:
        t = target.select(F.col(target_key).alias(out_key),
                          *[F.col(c).alias(a) for c, a in (target_cols or {}).items()])
        e = e.join(t, out_key)
    joined = left.join(e, left[left_key] == e["__near"], "left" if optional else "inner")
    return joined.drop("__near")


def var_length_paths(starts: DataFrame, start_key: str, edges: DataFrame, min_depth: int = 1,
                     max_depth: int = 5, node_names: DataFrame | None = None, name_key: str | None = None,
                     name_col: str | None = None, checkpoint_every: int = 1) -> DataFrame:
    """All paths ``(start)-[:E*min..max]->(end)`` that use no edge twice.

    Output: ``start, end, depth, nodes, chain`` (``nodes`` = node keys in path
    order; ``chain`` = their names when ``node_names`` is given, else the keys).
    Each step is one equi-join of the frontier with the edge table (names are
    joined onto the edges once, so they travel with the path); edges are
    identified by ``src->dst``. ``checkpoint_every`` cuts the lineage with
    reliable checkpoints for deep expansions.
    """
    e = edges.select("src", "dst").withColumn("_eid", F.concat_ws("->", F.col("src").cast("string"),
                                                                  F.col("dst").cast("string")))
    st = starts.select(F.col(start_key).alias("start"))
    if node_names is not None:
        names = node_names.select(F.col(name_key).alias("_k"), F.col(name_col).cast("string").alias("_name"))
        e = e.join(names.withColumnRenamed("_k", "dst"), "dst", "left")
        st = st.join(names.withColumnRenamed("_k", "start"), "start", "left")
    else:
        e = e.withColumn("_name", F.col("dst").cast("string"))
        st = st.withColumn("_name", F.col("start").cast("string"))
    frontier = st.select("start", F.col("start").alias("cur"), F.array(F.col("start")).alias("nodes"),
                         F.array(F.col("_name")).alias("chain"), F.array().cast("array<string>").alias("used"))
    results = []
    for depth in range(1, max_depth + 1):
        step = (frontier.join(e, frontier["cur"] == e["src"])
                .filter(~F.array_contains("used", F.col("_eid")))
                .select("start", F.col("dst").alias("cur"), F.concat("nodes", F.array("dst")).alias("nodes"),
                        F.concat("chain", F.array("_name")).alias("chain"),
                        F.concat("used", F.array("_eid")).alias("used")))
        if checkpoint_every and depth % checkpoint_every == 0:
            step = step.checkpoint()
        if depth >= min_depth:
            results.append(step.select("start", F.col("cur").alias("end"), F.lit(depth).alias("depth"),
                                       "nodes", "chain"))
        frontier = step
    return _union_all(results)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected edge list ``(src, dst)``: ``node, component`` (the smallest node key).

    Alternating star contraction: a large-star round hangs every larger neighbour of a node on the smallest node it
    knows, a small-star round does so with the smaller neighbours. The number of rounds grows with the logarithm of
    the longest chain, and the loop ends only when a round changes nothing, so no chain is cut short. A round is
    joins and hash aggregates (no neighbour list is gathered); one scalar per round reaches the driver, and each
    round's edges are written with a reliable checkpoint.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    e = (edges.filter(F.col("src") != F.col("dst"))
         .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct().checkpoint())
    mark = None
    while True:
        now = e.agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark or now["n"] == 0:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = (both.filter(F.col("v") > F.col("u")).join(least, "u")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(least, "u")
        e = (joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint())
    star = e.groupBy("u").agg(F.min("v").alias("component"))
    return (nodes.join(star, nodes["node"] == star["u"], "left")
            .select("node", F.coalesce("component", "node").alias("component")))


def reachable(starts: DataFrame, start_key: str, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Breadth-first reachability: ``start, node, depth`` (shortest hop count), to any depth unless the caller sets
    ``max_depth``.

    Each level joins the frontier (distinct (start, node) pairs) with the edges
    and removes pairs already visited with a left-anti join, so the work is
    O(edges x levels) however many paths exist. The loop stops when a
    level is empty (one scalar per level on the driver); the edges and every
    level are written with reliable checkpoints, so each is computed once and
    a lost executor only recomputes one level.
    """
    e = edges.select("src", "dst").distinct().checkpoint()  # read many times below: materialise once
    frontier = starts.select(F.col(start_key).alias("start"), F.col(start_key).alias("node")).checkpoint()
    visited = frontier.withColumn("depth", F.lit(0))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = (frontier.join(e, frontier["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
               .join(visited.select("start", "node"), ["start", "node"], "left_anti"))
        nxt = nxt.checkpoint()  # each level is computed once; lineage stays one level deep
        if nxt.isEmpty():
            break
        visited = visited.unionByName(nxt.withColumn("depth", F.lit(depth)))
        frontier = nxt
    return visited.filter(F.col("depth") > 0)
