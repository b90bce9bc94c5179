"""Edge builders: every relationship of the source graphs is one call.

All builders cost O(edges), never O(sources x targets): they derive targets
by arithmetic on dense target ordinals (``0 .. T-1``) from seeded hashes of
the source key, so no cross product, no per-row Python and no driver
collect is involved. Target tables are joined back by ordinal with an
equi-join. The draws are pure functions of (seed, relationship, source key),
so rebuilding any partition gives identical edges.

* ``fk_edges``          F7  child row carries the parent key
* ``bernoulli_edges``   F8-F10 each ordered pair kept with probability p
                        (geometric skips per source; optional block key,
                        optional self-pair exclusion, optional fan-out cap F18)
* ``distinct_pairs``    F11 n uniform distinct (a, b) pairs
* ``k_targets``         F13 k (fixed or per-source range) distinct targets per source
* ``lower_parent``      F14 one target of a strictly lower rank for a share of sources
* ``only_missing``      F15 sources without an edge of a type yet
* ``two_hop_targets``   F16 k targets reachable through a shared attribute
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import h60, int_between, unif


def dense_ordinals(df: DataFrame, order_cols: list[str], name: str = "_o",
                   partitions: int | None = None) -> DataFrame:
    """0-based ordinal of every row in ``order_cols`` order, without a single-task sort.

    Rows are range-partitioned on the order columns (each task holds one
    contiguous range), numbered inside their task, and shifted by the row
    counts of the preceding tasks (a per-task count table, one row per task). The numbered rows are written with a reliable checkpoint first,
    so the counts and the numbers come from the same partitioning.
    """
    # without an explicit count AQE coalesces the range partitions by size; merged partitions are
    # still contiguous key ranges in order, which is all the offsets below rely on
    ranged = df.repartitionByRange(partitions, *order_cols) if partitions else df.repartitionByRange(*order_cols)
    # the task and the place in it, from one sort inside the range partitions (no second shuffle)
    r = ranged.sortWithinPartitions(*order_cols).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    r = (r.withColumn("_pid", F.shiftright("_id", 33))
         .withColumn("_local", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"))
    counts = r.groupBy("_pid").agg((F.max("_local") + 1).alias("_c"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offs = counts.select("_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return (r.join(offs, "_pid").withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_pid", "_local", "_off"))


def ordinals(df: DataFrame, key: str, partition: list[str] | None = None, name: str = "_ord") -> DataFrame:
    """Dense 0-based ordinal of ``key`` (within each ``partition`` group if given).

    Built on ``dense_ordinals`` over (group, key): a group's ordinals are the
    global ones minus the group's first, so a hot group is spread over many
    tasks instead of being sorted in one.
    """
    groups = partition or []
    d = dense_ordinals(df, [*groups, key], "_g_o")
    if not groups:
        return d.withColumnRenamed("_g_o", name)
    first = d.groupBy(*groups).agg(F.min("_g_o").alias("_g_first"))
    return d.join(first, groups).withColumn(name, F.col("_g_o") - F.col("_g_first")).drop("_g_o", "_g_first")


def fk_edges(child: DataFrame, child_key: str, fk: str, parent: DataFrame, parent_key: str,
             props: list[Column] | None = None) -> DataFrame:
    """``(child)-[:T]->(parent)`` where ``child.fk = parent.key``; unmatched children drop."""
    e = child.select(F.col(child_key).alias("src"), F.col(fk).alias("dst"), *(props or []))
    p = parent.select(F.col(parent_key).alias("dst"))
    return e.join(p, "dst").select("src", "dst", *[c for c in e.columns if c not in ("src", "dst")])


#: Up to so many targets a pair is kept with the stated probability; with more, each source keeps the degree it would
#: expect with so many, so that edges grow with the sources and not with sources x targets. The source's own catalogues
#: have 2,000 targets at most.
DENSE_TARGETS = 2000


def _geometric_gaps(u: Column, p: Column) -> Column:
    """Gap to the next success of a Bernoulli(p) process: floor(ln(1-u)/ln(1-p)) + 1."""
    one = F.lit(1.0)
    return F.when(p >= one, F.lit(1).cast("bigint")).otherwise((F.floor(F.log(one - u) / F.log(one - p)) + 1).cast("bigint"))


def bernoulli_edges(sources: DataFrame, src_key: str, n_targets: Column | int, p: float, seed, rel: str,
                    block: str | None = None, exclude_self_ordinal: str | None = None,
                    max_per_source: int | None = None, dense_targets: int | None = DENSE_TARGETS) -> DataFrame:
    """Every (source, target-ordinal) pair kept independently with probability ``p``.

    For each source the successes of the Bernoulli process over target
    ordinals ``0 .. T-1`` are generated directly: gaps between successes are
    geometric, their running sums are the positions. Work per source is
    O(T*p) (the expected degree), and p shrinks as 1/T beyond ``dense_targets``
    targets, so edges are at most sources x p x dense_targets; with None the
    stated p holds for any number of targets. ``n_targets`` may be a per-source column (F10: the size of
    the source's block, with ``block`` the block ordinal offset column).

    Each source draws mean + 10 sigma + 32 gaps in one pass; if a source's
    last draw were still inside the target range the job fails rather than
    truncating (probability below 1e-20 per source). ``max_per_source`` (F18)
    keeps the first m successes of a per-source random rotation of the targets.

    Output: ``src, dst_ord`` (plus ``block`` if given).
    """
    T = n_targets if isinstance(n_targets, Column) else F.lit(int(n_targets))
    tcol = "_T"
    base = sources.select(F.col(src_key).alias("src"), T.cast("bigint").alias(tcol),
                          *([F.col(block)] if block else []),
                          *([F.col(exclude_self_ordinal).alias("_self")] if exclude_self_ordinal else []))
    # draws per source: expected degree + 10 sigma + 32 (a longer run has probability < 1e-20)
    prob = F.lit(float(p)) * (F.least(F.lit(1.0), F.lit(float(dense_targets)) / F.col(tcol)) if dense_targets else F.lit(1.0))
    mean = F.col(tcol) * prob
    size = (mean + F.lit(10.0) * F.sqrt(mean * (F.lit(1.0) - prob)) + F.lit(32.0)).cast("int")
    if max_per_source:  # one more, as the self pair may be among the first
        size = F.least(size, F.lit(int(max_per_source) + 1))
    size = F.greatest(size, F.lit(1))
    # running sums per source: the window's clustering on ``src`` is met by hash-partitioning the
    # (small) source rows before the explode, so the draws are only sorted locally, never shuffled
    w = Window.partitionBy("src").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    draws = (base.repartition("src").withColumn("_n", size)
             .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))))
    gap = _geometric_gaps(unif(seed, f"{rel}#gap", F.col("src"), F.lit(0), F.col("_i")), prob)
    pos = draws.withColumn("_pos", F.lit(-1).cast("bigint") + F.sum(gap).over(w))
    if not max_per_source:
        # never truncate silently: a source whose last draw is still inside the target range fails the
        # job (same pass, no second scan); with the margin above this does not happen in practice
        pos = pos.withColumn("_pos", F.when((F.col("_i") == F.col("_n")) & (F.col("_pos") < F.col(tcol) - 1),
                                            F.raise_error(F.concat(F.lit(f"bernoulli_edges({rel}): draws exhausted "
                                                                         "for source "), F.col("src").cast("string")))
                                            .cast("bigint")).otherwise(F.col("_pos")))
    edges = pos.filter(F.col("_pos") < F.col(tcol))
    if max_per_source:  # rotate first, so that the self pair is the one of the rotated targets
        rot = F.pmod(h60(seed, f"{rel}#rot", F.col("src")), F.col(tcol))
        edges = edges.withColumn("_pos", F.pmod(F.col("_pos") + rot, F.col(tcol)))
    if exclude_self_ordinal:
        edges = edges.filter(F.col("_pos") != F.col("_self"))
    if max_per_source:
        edges = edges.withColumn("_rank", F.row_number().over(Window.partitionBy("src").orderBy("_i"))).filter(F.col("_rank") <= int(max_per_source))
    return edges.select("src", F.col("_pos").alias("dst_ord"), *([F.col(block)] if block else []))


def distinct_pairs(index: DataFrame, index_col: str, a_count: Column | int, b_count: Column | int, seed,
                   rel: str) -> DataFrame:
    """one distinct uniform pair (a_ord, b_ord) per row of ``index`` (``index_col`` = 0..n-1).

    The index becomes the pair (i div B, i mod B), and four rounds shift one
    half by a keyed hash of the other, modulo A or B. Each round can be undone,
    so distinct indexes give distinct pairs, and the pairs scatter over the
    whole of A x B however small n is beside it. No shuffle, no driver-side
    count: A and B may be scalar-subquery Columns. The index is a dense key of
    the table whose rows the pairs belong to (e.g. one pair per line item).
    """
    d = "decimal(38,0)"
    A = (a_count if isinstance(a_count, Column) else F.lit(int(a_count))).cast("bigint")
    B = (b_count if isinstance(b_count, Column) else F.lit(int(b_count))).cast("bigint")
    p = (index.select(F.col(index_col).cast("bigint").alias("_i"), A.alias("_A"), B.alias("_B"))
         .filter(F.col("_i") < F.col("_A").cast(d) * F.col("_B").cast(d))
         .select("_A", "_B", F.floor(F.col("_i") / F.col("_B").cast(d)).cast("bigint").alias("_x"), F.pmod("_i", "_B").alias("_y")))
    for r in (0, 2):
        p = p.withColumn("_x", F.pmod(F.col("_x") + F.pmod(h60(seed, f"{rel}#{r}", F.col("_y")), F.col("_A")), F.col("_A")))
        p = p.withColumn("_y", F.pmod(F.col("_y") + F.pmod(h60(seed, f"{rel}#{r + 1}", F.col("_x")), F.col("_B")), F.col("_B")))
    # never null; said so that a join on them does not check it first, by all rounds once more inside a filter of the scan
    sure = [F.coalesce(c, F.lit(0).cast("bigint")) for c in ("_x", "_y")]
    return p.select(sure[0].alias("a_ord"), sure[1].alias("b_ord"))


def k_targets(sources: DataFrame, src_key: str, n_targets: Column | int, k_min: int, k_max: int, seed,
              rel: str) -> DataFrame:
    """each source gets k distinct target ordinals, k fixed or uniform in [k_min, k_max].

    Every k-subset of the targets is equally likely: draw j (of 1..k) is
    uniform below T - k + j, and where it was drawn before, T - k + j - 1 takes
    its place. k is capped at T. One explode per source, no shuffle.
    Output: ``src, j, dst_ord``.
    """
    T = n_targets if isinstance(n_targets, Column) else F.lit(int(n_targets))
    k = int_between(unif(seed, f"{rel}#k", F.col(src_key)), k_min, k_max) if k_max > k_min else F.lit(k_min)
    base = sources.select(F.col(src_key).alias("src"), T.cast("bigint").alias("_T"), k.cast("bigint").alias("_k"))
    base = base.withColumn("_k", F.least(F.col("_k"), F.col("_T"))).filter(F.col("_k") >= 1)
    if k_min == k_max == 1:  # nothing taken before the only draw, which is below T
        return base.select("src", F.lit(1).alias("j"), F.pmod(h60(seed, f"{rel}#draw", F.col("src"), F.lit(1).cast("bigint")), F.col("_T")).alias("dst_ord"))
    room = F.col("_T") - F.col("_k")

    def draw(taken: Column, j: Column) -> Column:
        x = F.pmod(h60(seed, f"{rel}#draw", F.col("src"), j), room + j)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, x), room + j - 1).otherwise(x)))

    picks = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("_k")), F.array().cast("array<bigint>"), draw)
    return (base.select("src", F.posexplode(picks).alias("_p", "dst_ord"))
            .select("src", (F.col("_p") + 1).alias("j"), "dst_ord"))


def lower_parent(nodes: DataFrame, key: str, rank: str, share: float, min_rank, seed, rel: str) -> DataFrame:
    """a ``share`` of nodes with rank >= ``min_rank`` get one parent of strictly lower rank.

    Nodes are ordered by (rank, key) into dense ordinals (range-partitioned,
    no single-task sort); the nodes of lower rank are exactly the ordinals
    below the first ordinal of the node's rank, so the parent is ordinal
    ``h mod count_lower`` (acyclic by construction).
    Output: ``src, dst``.
    """
    ordn = dense_ordinals(nodes.select(key, rank), [rank, key], "_o")
    lower = ordn.groupBy(rank).agg(F.min("_o").alias("_lower"))
    pick = (ordn.join(lower, rank)
            .filter((F.col(rank) >= F.lit(min_rank)) & (F.col("_lower") > 0)
                    & (unif(seed, f"{rel}#pick", F.col(key)) < F.lit(share)))
            .withColumn("_t", F.pmod(h60(seed, f"{rel}#target", F.col(key)), F.col("_lower"))))
    tgt = ordn.select(F.col("_o").alias("_t"), F.col(key).alias("dst"))
    return pick.join(tgt, "_t").select(F.col(key).alias("src"), "dst")


def only_missing(sources: DataFrame, key: str, existing_edges: DataFrame) -> DataFrame:
    """sources with no edge of the given type yet (left anti join on the source key)."""
    return sources.join(existing_edges.select(F.col("src").alias(key)).distinct(), key, "left_anti")


def two_hop_targets(sources: DataFrame, src_key: str, src_group: str, targets: DataFrame, tgt_key: str,
                    tgt_group: str, k: int, seed, rel: str) -> DataFrame:
    """F16: for each source, k distinct targets that share its group (e.g. teachers of the student's school).

    Targets get a dense ordinal inside their group and the group sizes are
    aggregated once; each source draws k ordinals below its group's size and
    joins them back on (group, ordinal). Cost O(sources x k), no pair expansion
    inside a group.
    Output: ``src, dst``.
    """
    t = ordinals(targets.select(F.col(tgt_key).alias("dst"), F.col(tgt_group).alias("_g")), "dst", ["_g"], "_o")
    sizes = t.groupBy("_g").agg(F.count("*").alias("_n"))
    s = sources.select(F.col(src_key).alias("src"), F.col(src_group).alias("_g")).join(sizes, "_g")
    picks = k_targets(s.withColumnRenamed("src", "_src"), "_src", F.col("_n"), k, k, seed, rel)
    picks = picks.withColumnRenamed("src", "_src").join(s.withColumnRenamed("src", "_src"), "_src")
    return picks.join(t.withColumnRenamed("_o", "dst_ord"), ["_g", "dst_ord"]).select(
        F.col("_src").alias("src"), "dst")
