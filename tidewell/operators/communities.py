"""Community detection: nodes move to the neighbouring community with the greatest gain in modularity.

``co_membership``  projects (group, member) rows to weighted member-member links without writing all pairs of a
                   group: a member is linked to the next ``reach`` members of its group, in an order drawn by hash,
                   so links grow with the rows
``communities``    a fixed number of rounds of local moves, then the same among the communities as nodes; half of the nodes, drawn by hash, move in a round, so two
                   neighbours do not swap for ever. Gains are integers (2m w(u, C) - k_u tot(C without u)), ties go
                   to staying and then to the least label, so every engine finds the same communities
``modularity``     links inside, degree and share of modularity of each community

Nodes are numbered in the order of their keys. The links, both ways, are dealt out by node once and kept so over the
rounds of a level (on disk what memory does not hold), so a round sums a node's links where they lie; only the node
table, which is a small part of the links, moves. Labels are written to the shared folder after each round, so a lost
executor repeats one round and what it kept of the links.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .edges import dense_ordinals, ordinals

WIDE = "decimal(38,0)"


def co_membership(rows: DataFrame, group: str, member: str, reach: int = 8, numbered: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``a, b, w``: members a < b and the number of groups that link them.

    ``numbered``: the links by the members' numbers, and ``node, name``, the numbers in the order of the members.
    """
    each = rows.select(F.col(group).alias("_g"), F.col(member).alias("_m")).filter(F.col("_g").isNotNull()).distinct()
    each = each.withColumn("_h", F.unhex(F.md5(F.concat_ws(":", F.col("_g").cast("string"), F.col("_m").cast("string")))))
    # places by range partitioning, so a large group is not sorted in one task
    placed = dense_ordinals(each, ["_g", "_h"], "_o").drop("_h")
    names = settled(ordinals(placed.filter(F.col("_m").isNotNull()).select(F.col("_m").alias("name")).distinct(), "name", name="node").select("node", "name"), "names")
    placed = placed.join(names.select(F.col("name").alias("_m"), F.col("node").alias("_x")), "_m", "left").drop("_m")
    # blocks of places; a block also sees the first rows of the next one
    size = 1024 * reach
    block = F.floor(F.col("_o") / F.lit(size))
    seen = placed.withColumn("_k", F.explode(F.when(F.pmod("_o", F.lit(size)) < reach, F.array(block, block - 1)).otherwise(F.array(block))))
    w = Window.partitionBy("_k").orderBy("_o")
    after = [F.lead(F.struct("_g", "_x"), i).over(w).alias(f"_n{i}") for i in range(1, reach + 1)]
    # a missing member is linked as least and greatest see it: its neighbour to itself
    near = [F.when(F.col(f"_n{i}._g") == F.col("_g"), F.coalesce(f"_n{i}._x", "_x")) for i in range(1, reach + 1)]
    near = (seen.select("_g", "_x", (block == F.col("_k")).alias("_own"), *after).filter("_own")
            .select("_x", F.explode(F.array(*near)).alias("_y")).filter(F.col("_y").isNotNull()))
    links = near.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    if numbered:
        return links, names
    return (links.join(names.select(F.col("node").alias("a"), F.col("name").alias("_a")), "a").join(names.select(F.col("node").alias("b"), F.col("name").alias("_b")), "b")
            .select(F.col("_a").alias("a"), F.col("_b").alias("b"), "w"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))))


def _dealt(ways: DataFrame) -> DataFrame:
    """``ways`` dealt out by ``a`` and kept so: what is grouped by ``a`` needs no further shuffle."""
    n = int(ways.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ways.repartition(n, "a").sortWithinPartitions("a").persist(StorageLevel.MEMORY_AND_DISK)


def communities(links: DataFrame, rounds: int = 8, levels: int = 2, names: DataFrame | None = None) -> DataFrame:
    """``node, community`` (a node's key) from weighted links ``a, b, w``; links of a node to itself are left out.

    After ``rounds`` rounds each community becomes one node, its links summed and its degree kept, and the moves start
    again among these, ``levels`` times in all. ``links`` is read twice. With ``names`` (node, name) the nodes of the links
    and of the result are numbers in the order of their names.
    """
    links = links.filter(F.col("a") != F.col("b"))
    degree = _both_ways(links).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    if names is not None:
        nodes, ways = settled(degree.join(names, "node").select("node", "name", "k"), "nodes"), _both_ways(links)
    else:
        nodes = settled(ordinals(degree.withColumnRenamed("node", "name"), "name", name="node").select("node", "name", "k"), "nodes")
        ways = _both_ways(links.join(nodes.select(F.col("name").alias("a"), F.col("node").alias("_a")), "a")
                          .join(nodes.select(F.col("name").alias("b"), F.col("node").alias("_b")), "b")
                          .select(F.col("_a").alias("a"), F.col("_b").alias("b"), "w"))
    keys = nodes.select("node", "name")
    found = None
    for level in range(levels):
        ways = _dealt(ways)
        label = _moves(ways, nodes, rounds)
        first = label.groupBy("community").agg(F.min("node").alias("_first"))
        label = settled(label.join(first, "community").select("node", "k", F.col("_first").alias("community")), "labels")
        of = label.select("node", "community")
        found = of if found is None else found.join(of.select(F.col("node").alias("community"), F.col("community").alias("_c")), "community").select("node", F.col("_c").alias("community"))
        if level + 1 < levels:
            ends = (ways.join(of.select(F.col("node").alias("a"), F.col("community").alias("_ca")), "a")
                    .join(of.select(F.col("node").alias("b"), F.col("community").alias("_cb")), "b"))
            above = settled(ends.filter(F.col("_ca") != F.col("_cb")).groupBy(F.col("_ca").alias("a"), F.col("_cb").alias("b")).agg(F.sum("w").alias("w")), "ways")
            degree = label.groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k"))
            nodes = settled(degree.join(nodes.select("node", "name"), "node").select("node", "name", "k"), "nodes")
        ways.unpersist()
        if level + 1 < levels:
            ways = above
    if names is not None:
        return found
    # back from numbers to keys
    found = found.join(keys.select("node", F.col("name").alias("_n")), "node")
    return found.join(keys.select(F.col("node").alias("community"), F.col("name").alias("_c")), "community").select(F.col("_n").alias("node"), F.col("_c").alias("community"))


def _moves(ways: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """``node, name, k, community`` after ``rounds`` rounds from communities of one node each.

    ``ways`` (a, b, w) has every link both ways, ``nodes`` (node, name, k) their keys, by which halves are drawn, and degrees.
    """
    size = nodes.agg(F.sum("k").alias("all"), F.max("k").alias("k"), F.max("node").alias("node")).first()  # one row
    twice, most, top = (int(x or 0) for x in size)
    # a gain and the label it belongs to in one long, if there is room for both; else as decimals
    narrow = (2 * twice * most + 1) * (top + 1) < 2 ** 63
    number = "bigint" if narrow else WIDE
    whole, span = F.lit(twice).cast(number), F.lit(top + 1).cast("bigint")
    label = nodes.withColumn("community", F.col("node"))
    for r in range(rounds):
        # half of the nodes, another half each time, so that neighbours come apart
        half = F.pmod(F.ascii(F.substring(F.md5(F.concat_ws(":", F.col("name").cast("string"), F.lit(str(r)))), 1, 1)), F.lit(2))
        tot = label.groupBy(F.col("community").alias("to")).agg(F.sum("k").alias("_tot"))
        movers = label.filter(half == 0).select(F.col("node").alias("u"), F.col("k").alias("ku"), F.col("community").alias("own"))
        votes = (ways.withColumnRenamed("a", "u").join(movers.select("u"), "u")
                 .join(label.select(F.col("node").alias("b"), F.col("community").alias("to")), "b")
                 .groupBy("u", "to").agg(F.sum("w").alias("w")).join(movers, "u").join(tot, "to"))
        other = F.col("to") != F.col("own")
        gain = whole * F.col("w").cast(number) - F.col("ku").cast(number) * F.col("_tot").cast(number)
        best = F.max(F.when(other, gain * span + (span - 1 - F.col("to")))) if narrow else F.min(F.when(other, F.struct((-gain).cast(WIDE).alias("g"), F.col("to"))))
        choice = (votes.groupBy("u", "ku", "own").agg(best.alias("_best"), F.max(F.when(~other, F.col("w"))).alias("_w"))
                  .join(tot.withColumnRenamed("to", "own"), "own"))
        # staying is a choice even without a neighbour in the own community
        stay = whole * F.coalesce("_w", F.lit(0)).cast(number) - F.col("ku").cast(number) * (F.col("_tot") - F.col("ku")).cast(number)
        better, to = (F.col("_best") >= (stay + 1) * span, span - 1 - F.pmod("_best", span)) if narrow else (-F.col("_best.g") > stay, F.col("_best.to"))
        moved = choice.filter(better).select(F.col("u").alias("node"), to.alias("_to"))
        label = settled(label.join(moved, "node", "left").select("node", "name", "k", F.coalesce("_to", "community").alias("community")), "labels")
    return label


def modularity(links: DataFrame, of: DataFrame) -> DataFrame:
    """``community, members, inside, degree, modularity`` of the communities ``of`` (node, community)."""
    links = links.filter(F.col("a") != F.col("b"))
    # the links between and inside communities in one pass; null where an end has none
    ends = settled(links.join(of.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a", "left")
                   .join(of.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b", "left")
                   .groupBy("ca", "cb").agg(F.sum("w").alias("w")), "ends")
    inside = ends.filter(F.col("ca") == F.col("cb")).groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("inside"))
    degree = _both_ways(ends.withColumnsRenamed({"ca": "a", "cb": "b"})).groupBy(F.col("a").alias("community")).agg(F.sum("w").alias("degree"))
    members = of.groupBy("community").agg(F.count(F.lit(1)).alias("members"))
    m = ends.agg(F.sum("w")).scalar().cast("double")
    out = members.join(degree, "community").join(inside, "community", "left").fillna(0, ["inside"])
    share = F.col("degree") / (2 * m)
    return out.select("community", "members", "inside", "degree", F.round(F.col("inside") / m - share * share, 6).alias("modularity"))
