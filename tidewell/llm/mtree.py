"""Exact top-k by integer inner product with M-trees.

Vectors become integers floor(scale * x). Inner product is no metric, but after giving every vector x one more
coordinate, sqrt(M^2 - |x|^2) with M the greatest norm of the tree, all have the norm M, and the Euclidean distance of x
to a query q (whose extra coordinate is 0) satisfies d^2 = |q|^2 + M^2 - 2 q.x: the nearest is the one of greatest
inner product, and distance bounds become bounds of scores.

An M-tree holds its vectors in pages. An entry of an inner page is a routing vector with the covering radius of its
subtree, its distance to the routing vector of the page it stands in, and its child page; an entry of a leaf is a vector
with that parent distance. The search takes pages from a queue in the order of the best score they can hold. In a page
the parent distances come first: by the triangle inequality |d(q, parent) - d(parent, entry)| - radius bounds the entry's
distance, so entries out of reach are skipped without computing their distance. The search ends when the queue's best
bound is below the k-th score (equal bounds are still searched, for ties by id).

Spark deals the vectors into blocks of bounded size by a hash, so a vector in a third of all rows is in every block; a
tree is built once for each block and written to the shared folder as pages. Queries, in blocks too, meet the trees; a
task searches one tree for one block of queries, and the partial results, k for each query and tree, are merged by an
aggregate that combines before its shuffle.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; vectors of another
length are never compared; a null id takes no part; rows with equal id are each a candidate, but none of the query's own
id; each distinct query row (id and vector) is searched once, and has ranks of its own; scores are exact while scaled components stay below 2^20 in size. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

SCALE = 64
PAGE = 1024
BLOCK = 16384
QUERY_BLOCK = 1024
#: Queries that search together, sharing products.
TOGETHER = 256
#: Relative slack of the distances, which are floating point; the scores themselves are exact.
SLACK = 1e-9


class MTree:
    """Pages of an M-tree over integer vectors (n, dim) with ids, built top down around sampled routing vectors. A leaf's
    vectors stand next to each other; so do the routing vectors of an inner page."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE):
        self.page = page
        norms = (x ** 2).sum(axis=1)
        self.most = float(norms.max())
        extra = np.sqrt(self.most - norms)
        self._full = np.concatenate([x, extra[:, None]], axis=1)
        self._random = np.random.default_rng(3)
        #: a page: (is leaf, ids, vectors, parent distances, radii, child pages)
        self.pages: list[tuple] = []
        self._ids = ids
        self.root = self._build(np.arange(len(ids)), None)
        del self._full, self._random, self._ids

    def _distances(self, places: np.ndarray, to: int) -> np.ndarray:
        d = self._full[places] - self._full[to]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _add(self, leaf: bool, places: np.ndarray, parent: int | None, radii: np.ndarray, children: np.ndarray) -> int:
        up = np.zeros(len(places)) if parent is None else self._distances(places, parent)
        vectors = self._full[places, :-1]
        small = np.float32 if np.abs(vectors).max(initial=0) < 1 << 20 else np.float64  # integers that a float32 holds exactly
        self.pages.append((leaf, self._ids[places], vectors.astype(small), up, radii, children))
        return len(self.pages) - 1

    def _build(self, places: np.ndarray, parent: int | None) -> int:
        if len(places) <= self.page:
            return self._add(True, places, parent, np.zeros(len(places)), np.full(len(places), -1))
        routing = self._random.choice(places, min(self.page, -(-len(places) // self.page) * 2), replace=False)
        far = np.stack([self._distances(places, int(r)) for r in routing])
        nearest = far.argmin(axis=0)
        if np.bincount(nearest, minlength=len(routing)).max() == len(places):  # all alike: any even split will do
            nearest = np.arange(len(places)) % len(routing)
        entries = []
        for i, r in enumerate(routing):
            own = nearest == i
            if own.any():
                entries.append((int(r), float(far[i, own].max()), self._build(places[own], int(r))))
        return self._add(False, np.array([e[0] for e in entries]), parent, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]))

    def top(self, queries: np.ndarray, own_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (scores, ids) of the k best, by score down and id up, without the query's own id.

        Every query searches best first with a queue of its own. In a round each takes its best page, and queries that
        take the same page share one product of the page's vectors."""
        norms = (queries ** 2).sum(axis=1)
        both = norms + self.most
        slack = SLACK * (both + 1)
        n = len(queries)
        worst = np.full(n, -np.inf)
        found = [(np.empty(0), np.empty(0, np.int64))] * n
        queues: list[list[tuple]] = [[(-np.inf, self.root, -1.0)] for _ in range(n)]

        def best(j: int, distance: np.ndarray) -> np.ndarray:
            """The greatest score at that distance or beyond."""
            return (both[j] - np.maximum(distance, 0) ** 2) / 2 + slack[j]

        busy = list(range(n))
        while busy:
            asked: dict[int, list[tuple[int, float]]] = {}
            for j in busy:
                bound, page, to_parent = heapq.heappop(queues[j])
                if -bound < worst[j]:
                    queues[j] = []
                else:
                    asked.setdefault(page, []).append((j, to_parent))
            for page, who in asked.items():
                leaf, ids, vectors, up, radii, children = self.pages[page]
                left = []
                for j, to_parent in who:  # the stored distances first
                    near = best(j, np.abs(to_parent - up) - radii) >= worst[j] if to_parent >= 0 else np.ones(len(ids), bool)
                    if near.any():
                        left.append((j, near))
                if not left:
                    continue
                some = np.logical_or.reduce([near for _, near in left])
                q = queries[[j for j, _ in left]]
                exact = np.float32 if float(norms.max()) * self.most < 2 ** 48 else np.float64  # sums of integers below 2^24
                dots = (vectors[some].astype(exact, copy=False) @ q.T.astype(exact)).astype(np.float64)
                for c, (j, near) in enumerate(left):
                    at = np.flatnonzero(near[some])
                    d = dots[at, c]
                    at = np.flatnonzero(some)[at]
                    if leaf:
                        good = d >= worst[j]
                        good &= ids[at] != own_ids[j]
                        self._keep(found, worst, j, d[good], ids[at[good]], k)
                    else:
                        far = np.sqrt(np.maximum(both[j] - 2 * d, 0))
                        bounds = best(j, far - radii[at])
                        for i in np.flatnonzero(bounds >= worst[j]).tolist():
                            heapq.heappush(queues[j], (-float(bounds[i]), int(children[at[i]]), float(far[i])))
            busy = [j for j in busy if queues[j]]
        return found

    @staticmethod
    def _keep(found: list, worst: np.ndarray, j: int, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        if len(scores) > 4 * k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        if len(scores):
            s, i = np.append(found[j][0], scores), np.append(found[j][1], ids)
            order = np.lexsort((i, -s))[:k]
            found[j] = s[order], i[order]
            if len(order) == k:
                worst[j] = s[order[-1]]


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """array<double> of floor(scale * x), null unless every component is a finite number."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(embedding) > 0)
    return F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def build_trees(vectors: DataFrame, block: int = BLOCK, page: int = PAGE) -> DataFrame:
    """``vectors`` (vec_id, v) -> one row for each block: dim, tree, data (its pages, pickled)."""
    n = vectors.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / block).alias("trees"))
    dealt = vectors.withColumn("dim", F.size("v")).join(n, "dim").withColumn("tree", F.pmod(F.xxhash64("vec_id", F.hash("v")), F.col("trees")))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        ids, dim = rows["vec_id"].to_numpy(), key[0].as_py()
        order = np.argsort(ids, kind="stable")
        x = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        data = pickle.dumps(MTree(ids[order], x[order], page), protocol=5)
        return pa.table({"dim": [dim], "tree": [key[1].as_py()], "data": [data]}, schema=pa.schema([("dim", pa.int32()), ("tree", pa.int64()), ("data", pa.binary())]))

    return dealt.select("dim", "tree", "vec_id", "v").groupBy("dim", "tree").applyInArrow(build, "dim int, tree long, data binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK, page: int = PAGE) -> DataFrame:
    """``vectors`` and ``queries`` (vec_id, v) -> query_id, rank, vec_id, score."""
    trees = scratch(build_trees(vectors, block, page), "trees")
    homes_per = trees.groupBy("dim").agg(F.max("tree").alias("last_tree"))
    queries = queries.dropDuplicates(["vec_id", "v"]).withColumn("q", F.xxhash64("vec_id", "v"))
    parts_per = queries.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / query_block).alias("parts"))
    zero = F.lit(0).cast("long")
    asked = (queries.withColumn("dim", F.size("v")).join(parts_per, "dim").join(homes_per, "dim")
             .withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts")))
             .select("dim", "part", F.explode(F.sequence(zero, F.col("last_tree"))).alias("tree"), "vec_id", "v", "q"))
    homes = trees.join(parts_per, "dim").select("dim", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"), "tree", "data")

    def search(key: tuple, home: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if asked.num_rows and home.num_rows:
            tree = pickle.loads(home["data"][0].as_py())
            vs = asked["v"].combine_chunks().flatten().to_numpy().reshape(-1, key[0].as_py())
            own, queries = asked["vec_id"].to_numpy(), asked["q"].to_numpy()
            for a in range(0, len(own), TOGETHER):
                for i, q, (scores, ids) in zip(own[a: a + TOGETHER].tolist(), queries[a: a + TOGETHER].tolist(), tree.top(vs[a: a + TOGETHER], own[a: a + TOGETHER], k)):
                    out[0].extend([i] * len(ids))
                    out[1].extend(ids.tolist())
                    out[2].extend(scores.astype(np.int64).tolist())
                    out[3].extend([q] * len(ids))
        return pa.table({n: pa.array(o, pa.int64()) for n, o in zip(("query_id", "vec_id", "score", "q"), out)})

    by = ["dim", "part", "tree"]
    found = homes.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score long, q long")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = SCALE) -> DataFrame:
    """The k best of all other rows of ``embeddings`` (vec_id, embedding) for each row with vec_id divisible by ``every``."""
    v = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"))
         .where("vec_id IS NOT NULL AND v IS NOT NULL"))
    return top_k(v, v.where(F.col("vec_id") % every == 0), k)
