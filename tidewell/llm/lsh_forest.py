"""Near-duplicate join on word shingles by MinHash bands, after the LSH forest, with exact verification.

A document is the set of its five-word shingles. For each tree it has a label, a row of min-hashes, and documents whose
labels share a prefix meet. The prefix has one length, the longest with which a pair at the threshold meets with the
target recall (`prefix_length`); unlike in a forest, labels are not kept, sorted or shortened on the data. Steps:

1. One pass over the texts makes each document's set digest, tree prefixes and a 512-bit sketch (the low bits of
   min-hashes). Documents with equal sets become one node.
2. Prefixes are shuffled; each run of two or more nodes under one prefix is a meeting. Meetings whose sketches are far
   from the threshold are dropped (at the threshold the sketch errs by five standard deviations or it passes), the
   others are joined: every two nodes of a run are compared, and an edge joins two clusters of like nodes.
3. Connected components of those edges bound where true pairs can lie. The texts of the nodes in a component come
   together in blocks of bounded size (a larger component goes by pairs of blocks), where all pairs get their exact
   Jaccard similarity by a sparse product. Pairs are only counted: a block sends on a link count for each node and a
   spanning forest of its links.
4. Connected components of those verified links are the classes.

Words are runs of letters and digits, lower case (bytes of non-ASCII characters count as letters). Defined results: a
text of one to four words has one shingle, of them all, and a wordless text one of the text itself; null and empty texts
have the empty set and are copies of each other; every row counts as a document, repeated rows too; links never counts the row itself; class_id
is the smallest doc_id of the class (null ids are ignored unless all are null). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.graph import connected_components

from .common import U64, mix64, scratch, span_hashes, with_found, word_spans

WORDS = 5
THRESHOLD = 0.8
TREES, LONGEST, RECALL = 64, 16, 0.9999
SKETCH = 512
BLOCK = 512

_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def prefix_length(trees: int = TREES, longest: int = LONGEST, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability ``recall``."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def sketch_least(threshold: float = THRESHOLD, bits: int = SKETCH) -> int:
    """Equal sketch bits that a pair at the threshold has but for a five-sigma accident."""
    p = (1 + threshold) / 2
    return int(bits * p - 5 * (bits * p * (1 - p)) ** 0.5)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_spans(data, _is_word)
    if not len(starts):
        return span_hashes(data, np.zeros(min(1, len(data)), np.int64), np.full(min(1, len(data)), len(data)))
    # hash long texts in windows, so that the tables of powers stay small
    h = np.empty(len(starts), U64)
    i, step = 0, 1 << 20
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
        h[i:j] = span_hashes(data[starts[i]: ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    k = min(words, len(h))
    s = np.zeros(len(h) - k + 1, U64)
    for n in range(k):
        s = mix64(s * U64(0x9E3779B97F4A7C15) + h[n: len(h) - k + 1 + n])
    return np.unique(s)


class Signer:
    """Min-hashes by multiply-shift of 32-bit folds of the shingles, a few hundred shingles at a time."""

    def __init__(self, trees: int, depth: int, sketch: int = SKETCH):
        r = np.random.default_rng(20240607)
        self.trees, self.depth, self.sketch = trees, depth, sketch
        n = max(trees * depth, sketch)
        self.a = (r.integers(1, 1 << 31, n, dtype=np.uint64) * U64(2) + U64(1)).astype(np.uint32)[:, None]
        self.b = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]

    def minima(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        x = (s ^ (s >> U64(32))).astype(np.uint32)
        for i in range(0, len(x), 256):
            v = x[None, i: i + 256] * self.a
            v ^= v >> np.uint32(15)
            v *= self.b | np.uint32(1)
            v ^= v >> np.uint32(13)
            np.minimum(low, v.min(axis=1), out=low)
        return low

    def sign(self, s: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(a 64-bit hash of each tree's prefix, the sketch)"""
        low = self.minima(s)
        labels = low[: self.trees * self.depth].reshape(self.trees, self.depth).astype(U64)
        h = np.arange(1, self.trees + 1).astype(U64)
        for c in range(self.depth):
            h = mix64(h * U64(0x9E3779B97F4A7C15) + labels[:, c])
        return h.view(np.int64), np.packbits(((low[: self.sketch] >> np.uint32(7)) & np.uint32(1)).astype(bool)).tobytes()


def signatures(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, th (hash of the text), d1, d2 (set digest), prefixes, sketch; one row for each row of ``docs``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(trees, depth)
        for b in batches:
            d1, d2, pre, sk = [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py())
                d1.append(int(mix64(s + U64(1)).sum(dtype=U64).view(np.int64)))
                d2.append(int((mix64(s ^ U64(0xABCDEF0123456789)).sum(dtype=U64) + U64(len(s))).view(np.int64)))
                p, k = signer.sign(s)
                pre.append(p if len(s) else p[:0])
                sk.append(k)
            n = [0, *np.cumsum([len(p) for p in pre]).tolist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "th": b.column("th"), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()),
                "prefixes": pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(np.concatenate(pre) if pre else [], pa.int64())),
                "sketch": pa.array(sk, pa.binary())})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        rows, "doc_id long, th long, d1 long, d2 long, prefixes array<long>, sketch binary")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix -> those whose prefix another row has. Holds one row back, never a run."""
    key, node, met = np.empty(0, np.int64), np.empty(0, np.int64), False
    for b in batches:
        if not b.num_rows:
            continue
        key, node = np.append(key, b.column("prefix").to_numpy()), np.append(node, b.column("node").to_numpy())
        same = key[1:] == key[:-1]
        meets = np.append(met, same) | np.append(same, False)
        out = meets[:-1]
        yield pa.RecordBatch.from_pydict({"prefix": pa.array(key[:-1][out], pa.int64()), "node": pa.array(node[:-1][out], pa.int64())})
        key, node, met = key[-1:], node[-1:], bool(meets[-1])
    if met:
        yield pa.RecordBatch.from_pydict({"prefix": pa.array(key, pa.int64()), "node": pa.array(node, pa.int64())})


def _edges(least: int, step: int = 1024):
    """Rows (prefix, node, sketch) sorted by prefix and node -> edges (src, dst) that join the like nodes of a run. A run is
    taken ``step`` nodes at a time: they are compared with each other and with all nodes of the steps before, a slice after
    the other, and one edge joins two clusters that have like nodes."""
    def like(x, y):
        return SKETCH - np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int32) >= least

    def link(nodes, sk, before):
        """``before``: the run's nodes so far, their sketches, and the place of each one's cluster in the run."""
        old, old_sk, cluster = before
        n = len(old)
        own = like(sk, sk)
        root = np.arange(len(nodes))
        while True:  # smallest label of the likes, to the end
            new = np.where(own, root[None, :], len(nodes)).min(axis=1)
            if (new == root).all():
                break
            root = new
        tied = root != np.arange(len(nodes))
        pairs = [np.empty(0, np.int64)]
        for a in range(0, n, step):
            i, j = np.nonzero(like(sk, old_sk[a: a + step]))
            pairs.append(np.unique(root[i] * np.int64(max(1, n)) + cluster[a + j]))
        pairs = np.unique(np.concatenate(pairs))
        c, r = pairs // max(1, n), pairs % max(1, n)
        all_nodes = np.append(old, nodes)
        cluster = np.append(cluster, root + n)
        to = np.arange(len(all_nodes))  # joins clusters that one of the step's clusters ties together
        while True:
            new = to.copy()
            np.minimum.at(new, c + n, to[r])
            np.minimum.at(new, r, new[c + n])
            if (new == to).all():
                break
            to = new
        return np.append(nodes[tied], nodes[c]), np.append(nodes[root[tied]], old[r]), (all_nodes, np.concatenate([old_sk, sk]), to[cluster])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        nothing = np.empty(0, np.int64), np.empty((0, SKETCH // 64), U64), np.empty(0, np.int64)
        before = nothing
        for b in batches:
            prefix, node = b.column("prefix").to_numpy(), b.column("node").to_numpy()
            sk = np.frombuffer(b"".join(b.column("sketch").to_pylist()), U64).reshape(-1, SKETCH // 64)
            at = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])) if len(prefix) else np.empty(0, np.int64)
            src, dst = [], []
            for i, j in zip(at, np.append(at[1:], len(prefix))):
                if prefix[i] != key:
                    key, before = prefix[i], nothing
                for a in range(i, j, step):
                    c = min(j, a + step)
                    s, d, before = link(node[a:c], sk[a:c], before)
                    src.append(s)
                    dst.append(d)
            yield pa.RecordBatch.from_pydict({"src": pa.array(np.concatenate(src) if src else [], pa.int64()),
                                              "dst": pa.array(np.concatenate(dst) if dst else [], pa.int64())})
    return rows


def candidate_edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """(src, dst) from ``nodes`` (node, prefixes, sketch)."""
    spread = nodes.select("node", F.explode("prefixes").alias("prefix"))
    met = scratch(spread.repartition("prefix").sortWithinPartitions("prefix", "node").mapInArrow(_meetings, "prefix long, node long"), "met")
    with_sketch = met.join(nodes.select("node", "sketch").hint("merge"), "node").select("prefix", "node", "sketch")
    return (with_sketch.repartition("prefix").sortWithinPartitions("prefix", "node")
            .mapInArrow(_edges(sketch_least(threshold)), "src long, dst long").distinct())


def _verify(threshold: float):
    """Rows (block, side, node, copies, text) sorted by block -> for each node of a block its links there and the root
    of its tree in a spanning forest of the links. side 0 or 1 are compared with each other, -1 with its own."""
    def block_rows(side, node, copies, texts):
        sets = [shingles(t) for t in texts]
        n = len(sets)
        size = np.array([len(s) for s in sets], np.int64)
        doc = np.repeat(np.arange(n), size)
        values, column, df = np.unique(np.concatenate(sets) if n else np.empty(0, U64), return_inverse=True, return_counts=True)
        shared = df[column] > 1
        doc, column = doc[shared], (np.cumsum(df > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        both = np.zeros((n, n), np.float32)
        width = 4096
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            i, j = np.searchsorted(column, [c, c + width])
            m = np.zeros((n, width), np.float32)
            m[doc[i:j], column[i:j] - c] = 1
            both += m @ m.T
        pair = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-3
        # decide exactly, in integers of thousandths, what the tolerance let through
        exact = np.rint(both).astype(np.int64)
        pair &= 1000 * exact >= round(1000 * threshold) * (size[:, None] + size[None, :] - exact)
        np.fill_diagonal(pair, False)
        pair &= (side[:, None] < 0) | (side[:, None] != side[None, :])
        links = pair @ copies
        root = np.arange(n)
        while True:
            new = np.minimum(root, np.where(pair, root[None, :], n).min(axis=1, initial=n))
            new = new[new]
            if (new == root).all():
                break
            root = new
        return node, links, node[root]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table):
            key = table["block"].to_numpy()
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            out = ([], [], [])
            for i, j in zip(at, np.append(at[1:], len(key))):
                part = table.slice(i, j - i)
                node = part["node"].to_numpy()
                _, first = np.unique(node, return_index=True)  # a repeated row has the same text
                got = block_rows(part["side"].to_numpy()[first], node[first], part["copies"].to_numpy()[first],
                                 part["text"].take(pa.array(first)).to_pylist())
                for o, g in zip(out, got):
                    o.append(g)
            return pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(o), pa.int64()) for k, o in zip(("node", "links", "root"), out)})

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            key = b.column("block")
            if key[0] != key[b.num_rows - 1] or (len(held) > 1 and held[0].column("block")[0] != key[0]):
                table = pa.Table.from_batches(held).combine_chunks()
                k = table["block"].to_numpy()
                cut = int(np.searchsorted(k, k[-1]))
                yield done(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))
    return rows


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, th (hash of the text), class_id, links, and kept: true for one row of
    each class, of its smallest doc_id (of equal rows: all)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = scratch(signatures(docs, trees, prefix_length(trees, LONGEST, threshold, recall)).withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = scratch(sig.groupBy("d1", "d2").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least")), "nodes")
    # merge hints: the plan is the same at every size, and no side that grows with the data is broadcast
    own = sig.join(nodes.select(F.col("node").alias("row")).hint("merge"), "row").select(F.col("row").alias("node"), "prefixes", "sketch")
    candidates = connected_components(scratch(candidate_edges(own, threshold), "candidates"))
    sized = candidates.join(candidates.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    member = scratch(sized.join(nodes.select("node", "copies").hint("merge"), "node")
                     .join(sig.select(F.col("row").alias("node"), F.col("doc_id").alias("id"), F.col("th").alias("h")).hint("merge"), "node"), "members")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(5)), blocks).cast("int")
    spread = (member.withColumn("blocks", blocks).withColumn("b", mine)
              .select("id", "h", "node", "copies", "component", "blocks", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
              .select("id", "h", "node", "copies", F.when(F.col("b") == F.col("o"), -1).when(F.col("b") < F.col("o"), 0).otherwise(1).cast("long").alias("side"),
                      F.xxhash64("component", F.least("b", "o"), F.greatest("b", "o")).alias("block")))
    texts = docs.withColumn("h", F.xxhash64("text")).withColumnRenamed("doc_id", "id")
    together = (texts.join(spread.hint("merge"), texts["id"].eqNullSafe(spread["id"]) & (texts["h"] == spread["h"]))
                .select("block", "side", "node", "copies", "text"))
    found = scratch(together.repartition("block").sortWithinPartitions("block", "side", "node")
                    .mapInArrow(_verify(threshold), "node long, links long, root long"), "verified")
    links = found.groupBy("node").agg(F.sum("links").alias("others"))
    classes = connected_components(found.where("root <> node").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    tied = scratch(nodes.join(links, "node", "left").join(classes, "node", "left")
                   .select("d1", "d2", F.coalesce("component", "node").alias("class"),
                           (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "least"), "classes")
    first = tied.groupBy("class").agg(F.min("least").alias("first"))
    tied = tied.join(first, "class").select("d1", "d2", "links", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first"))
    return sig.select("doc_id", "th", "row", "d1", "d2").join(tied.hint("merge"), ["d1", "d2"]).select(
        "doc_id", "th", "class_id", "links", (F.col("row") == F.col("first")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class, the one of the smallest doc_id (null last); all columns stay."""
    one, (th,) = with_found(docs, near_duplicates(docs, threshold).where("kept"), "inner")
    return one.dropDuplicates(["doc_id", th]).select(*(F.col(f"`{c}`") for c in docs.columns))
