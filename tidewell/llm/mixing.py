"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame and SQL functions only.

The mix is a sequence of slots of ``block`` words. Slot i is the point v(i) of the van der Corput sequence (the bits of
i mirrored at the binary point); the cumulative target weights cut [0, 1) into one interval for each source, and the
interval that holds the point names the slot's source. The rank of a slot among its source's slots needs no sort: the
points before i that lie below an interval's end are counted from the bits of i, as each set bit stands for an evenly
spaced comb of points. So a schedule of any length is a projection of a range of numbers.

The documents of a source, in the order of a keyed hash, form its stream, which repeats. The stream is cut into blocks of
equal words, and rank r takes block r. A source takes as many words as its target (rounded down), so its last block may
be short; ranks beyond it are unused, and the few blocks that find no slot follow at the end of the mix by rank and source.
The mix (`mix`) is what the scheduled slots take: pieces of documents by slot. What a document gives (`takes`) and the
mixed corpus, of exact takes in slot order (`scheduled_documents`) or of whole documents by rounding (`mixed_documents`),
are sums over those pieces.

Targets: the sources by code point (null last) weigh 1, 2, 3, repeating, and share the total size; a target stops at
three times the source's size, and the excess is shared by the others by weight until none is above.

Places in a stream are running sums over hash buckets, then within a bucket, so a source with a third of all rows is not
one task. Defined results: a null text has size 0; documents of size 0 take nothing; without any words all targets are 0;
a null doc_id has the empty key; rows with equal doc_id follow each other by the hash of their texts. Extra columns are
ignored by `mix` and `takes` and pass through the mixed corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, fresh, scratch, with_found

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK = 1024
#: Points are integers of so many bits; a schedule has at most 2^BITS slots.
BITS = 40
SEED = 17
#: The source intervals are met by cells of 2^-CELL.
CELL = 10
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, th, source, size, the keyed hash h that shuffles, and its bucket (4096), of every row."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
    ).withColumn("bucket", F.substring("h", 1, 3))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """src (place by name), source, source_size, target, and low and high, the source's interval in units of 2^-BITS;
    one row for each source.

    A source is capped when the level at which the other words meet the other weights is above its own cap by weight;
    in ascending order of cap by weight that level is made of running sums."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    n = F.row_number().over(by_name)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(n - 1, F.lit(len(weights))) + 1).cast("int"))
    s = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
         .select("source", "source_size", n.alias("src"), w.cast("double").alias("w"), (F.col("source_size") * most).cast("double").alias("cap")))
    before = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = ((F.sum("cap").over(every) / most - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every))
    s = s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))))
    share = F.sum("target").over(by_name) / F.greatest(F.sum("target").over(every), F.lit(1e-300))
    s = s.withColumn("high", F.when(F.col("target") > 0, F.round(share * (1 << BITS)).cast("long")))
    s = s.withColumn("high", F.coalesce(F.max("high").over(by_name), F.lit(0).cast("long")))
    return s.select("src", "source", "source_size", "target", F.coalesce(F.lag("high").over(by_name), F.lit(0).cast("long")).alias("low"), "high")


def point(i: Column) -> Column:
    """The van der Corput point of slot i: its BITS bits mirrored, as an integer."""
    return F.conv(F.reverse(F.lpad(F.bin(i), BITS, "0")), 2, 10).cast("long")


def points_below(i: str, mirrored: str, x: str) -> Column:
    """How many of the points before i lie below x. The numbers before i fall, for each set bit b of i, into 2^b numbers
    that share the bits above; their points are offset + k * 2^(BITS - b)."""
    return F.expr(f"""aggregate(sequence(0, {BITS - 1}), 0L, (a, b) -> a + if((shiftright({i}, b) & 1L) = 0, 0L,
        if({x} > ({mirrored} & (shiftleft(1L, {BITS - 1} - b) - 1)),
           least(shiftleft(1L, b), shiftright({x} - ({mirrored} & (shiftleft(1L, {BITS - 1} - b) - 1)) - 1, {BITS} - b) + 1), 0L)))""")


def schedule(spark: SparkSession, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: slot, src, rank; every block of every source has one slot, numbers ascend by rank within a
    source and may have gaps. ``goals`` is the (small) table of `targets`.

    There are as many points as blocks. A source whose points are fewer than its blocks (by the discrepancy, a number
    that grows with the logarithm of the slots) gets slots behind the last point for the rest."""
    goals = goals.withColumn("blocks", F.ceil(F.floor(F.col("target") + 1e-6) / block))
    n, sources = goals.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count(F.lit(1))).first()
    if n >= 1 << BITS:
        raise ValueError("the schedule has more slots than points")
    slots = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("p")).withColumn("cell", F.shiftright("p", BITS - CELL))
    wide = goals.where("high > low").select("src", "low", "high", "blocks", F.explode(
        F.sequence(F.shiftright("low", BITS - CELL), F.shiftright(F.col("high") - 1, BITS - CELL))).alias("cell"))
    met = slots.join(wide, "cell").where("p >= low AND p < high")
    ranked = met.withColumn("rank", points_below("slot", "p", "high") - points_below("slot", "p", "low"))
    end = goals.withColumn("n", F.lit(n).cast("long")).withColumn("p", point(F.col("n")))
    end = end.withColumn("met", points_below("n", "p", "high") - points_below("n", "p", "low")).where("met < blocks")
    end = end.select("src", "met", F.explode(F.sequence("met", F.col("blocks") - 1)).alias("rank"))
    late = F.lit(n) + (F.col("rank") - F.col("met")) * sources + F.col("src") - 1
    return ranked.where("rank < blocks").select("slot", "src", "rank").unionByName(end.select(late.cast("long").alias("slot"), "src", "rank"))


def _places(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``sized`` with the source's columns and the start of each row in its source's stream."""
    known = goals.select("src", F.col("source").alias("_s"), "source_size", "target")
    d = sized.join(known, sized["source"].eqNullSafe(known["_s"])).drop("_s")
    sums = d.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inner = Window.partitionBy("src", "bucket").orderBy("h", F.asc_nulls_first("doc_id"), "th", "row").rowsBetween(Window.unboundedPreceding, -1)
    return d.join(sums, ["src", "bucket"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0)))


def _mix(docs: DataFrame, weights: tuple[int, ...], most: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their places, and the pieces of them in the scheduled slots."""
    sized = scratch(sizes(docs, seed).withColumn("row", F.monotonically_increasing_id()), "sizes")
    goals = scratch(targets(sized, weights, most).coalesce(1), "targets")
    placed = scratch(_places(sized, goals).select("row", "doc_id", "th", "source", "size", "src", "source_size", "target", "at"), "places")
    goal = F.floor(F.col("target") + 1e-6)
    begin = F.col("at") + F.col("pass") * F.col("source_size")
    passes = (placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
              .select("row", "doc_id", "th", "source", "size", "src", "pass", begin.alias("begin"), F.least(begin + F.col("size"), goal).alias("end")).where("end > begin"))
    cut = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    first = F.greatest("begin", F.col("rank") * block)
    pieces = cut.select("row", "doc_id", "th", "source", "size", "src", "rank", "pass", (first - F.col("begin")).alias("start"),
                        (F.least("end", (F.col("rank") + 1) * block) - first).alias("words"), "begin")
    return placed, pieces.join(schedule(docs.sparkSession, goals, block), ["src", "rank"])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix, one row for each piece of a document in a slot: slot, source, rank (the block of the source's stream), place
    (the piece's first word within the slot), doc_id, th (hash of the text), pass (which repeat of the document), start
    (the piece's first word within the document) and words. By slot and place it is the order to train in."""
    place = F.col("begin") + F.col("start") - F.col("rank") * block
    return _mix(docs, weights, most, block, seed)[1].select("slot", "source", "rank", place.alias("place"), "doc_id", "th", "pass", "start", "words")


def takes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, th, source, size, source_size, target, taken (words that the slots take
    of it, repeats counted) and first_slot (where the mix first meets it, null if it takes nothing)."""
    placed, pieces = _mix(docs, weights, most, block, seed)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return placed.join(taken, "row", "left").select("doc_id", "th", "source", "size", "source_size", "target",
                                                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each document as many times as its taken words go into its size (rounded), so
    those of a source above its target stay out, and those of a source below repeat. Rows with equal doc_id, source and
    text count together, with the other columns of one of them."""
    times = (takes(docs, **options).groupBy("doc_id", "source", "th")
             .agg(F.sum(F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")).alias("n")).where("n > 0"))
    met, (th, n) = with_found(docs, times, "inner", ("n",), ("source",))
    one = met.dropDuplicates(["doc_id", "source", th])
    each = fresh(one, "_each")
    return one.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def scheduled_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``docs`` exactly as the mix takes them, in the order of its slots: one row for each pass of a document, at the slot of its
    first piece. A pass that the source's target ends has the text only up to the last word taken; documents of a source
    above its target stay out, those of a source below repeat. The words of a source's rows add up to its target. Rows
    with equal doc_id, source and text share the other columns of one of them."""
    pieces = _mix(docs, weights, most, block, seed)[1]
    whole = pieces.groupBy("row", "pass").agg(F.min(F.struct("slot", "begin")).alias("at"), F.sum("words").alias("words"), *(F.first(c).alias(c) for c in ("doc_id", "th", "source", "size")))

    def key(doc_id: Column, th: Column, source: Column) -> Column:
        return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), th.cast("string"), F.coalesce(F.concat(F.lit(":"), source), F.lit(""))))

    # one key for both sides, so that the distinct texts are where the join needs them
    text, wide, names = F.col("text").cast("string"), docs, []
    for c in ("key", "own", "at", "words", "size"):
        names.append(fresh(wide, f"_{c}"))
        wide = wide.withColumn(names[-1], F.lit(None))
    k, own, at, words, size = names
    one = docs.withColumn(own, key(F.col("doc_id").cast("long"), F.xxhash64(text), F.col("source").cast("string"))).dropDuplicates([own])
    taken = whole.select(key(F.col("doc_id"), F.col("th"), F.col("source")).alias(k), F.col("at").alias(at), F.col("words").alias(words), F.col("size").alias(size))
    met = one.join(taken.hint("merge"), one[own] == taken[k])
    ordered = met.repartitionByRange(F.col(f"{at}.slot"), F.col(f"{at}.begin")).sortWithinPartitions(F.col(f"{at}.slot"), F.col(f"{at}.begin"))
    return columns_of(ordered, docs, {"text": F.when(F.col(words) < F.col(size), first_words(text, F.col(words))).otherwise(F.col("text"))})
