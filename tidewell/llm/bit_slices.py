"""Ranked lexical search over bit-sliced Bloom signatures.

The index has one Bloom signature for each document: for a term that occurs tf times, the keys (term, level) of every level
up to log2(tf) set `PROBES` bits each. Documents of like size (half octaves of their number of keys) share blocks of up to
`ROWS` documents, whose signatures have the same width, `BITS` or more for each key. A block is stored by slices: one bitmap
over its documents for each signature bit. Beside them stand the documents' ids, text hashes and exact term counts.
Statistics of the index are the number of documents that hold each term, and the totals N and L.

A search takes the bitmap of a (term, level) as the AND of its slices; a set bit may be false, a clear bit never is. Level l
bounds tf by 2^(l+1) - 1 (the last level by infinity), and the document's length is exact, so a term's weight times its
greatest possible factor, where its bit is set, bounds the term's part of the score, and the sum over an item's terms, in
integers, bounds the score. Search goes in two rounds. The first takes each item's documents of the greatest bounds and
scores them exactly; the least of those k scores is the item's threshold. The second scores exactly every document whose
bound reaches the threshold, so no document is left out that is not provably below the k best.

Distribution: the index is built where the texts are read (statistics are combined in the task, then by an aggregate), in
bounded blocks, and written to the shared folder. Queries go in blocks of about `QUERY_TERMS` terms, the only thing that is
broadcast; a task meets one block of documents at a time. Exact scores come from the whole texts, joined to the found ids
and text hashes; texts are shuffled only if what was found is too large for Spark to broadcast by its measured size.

Terms are maximal runs of ASCII letters and digits and all other non-ASCII code points, A-Z in lower case. They are told
apart by 64-bit hashes in the index and its statistics, and as strings in exact scores. Defined results: null and empty texts
have no terms and are never found; rows of equal doc_id are documents of their own, ties of score go by doc_id, null last;
an item is a distinct pair of id and text; a null text or one without known terms finds nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, by_size, mix64, scratch, span_hashes, word_spans

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Signature bits for each key at least, bits a key sets, levels of term frequency.
BITS, PROBES, LEVELS = 12, 5, 7
#: Documents of a block at most, and bits of a block about.
ROWS, BLOCK_BITS = 1024, 1 << 23
#: Distinct terms of all items in a block of queries, about; (terms x documents) held at once while bounds are summed.
QUERY_TERMS, CELLS = 1 << 16, 1 << 21
#: Distinct terms a task counts before it sends the counts on.
COUNTED = 1 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_term = np.zeros(256, bool)
_is_term[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LEVEL = 0xC2B2AE3D27D4EB4F


def terms_of(text: str | None) -> list[str]:
    """Terms in order; only ASCII letters are lower-cased."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = 1 << 20) -> np.ndarray:
    """`span_hashes` of long data, window by window."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + window, "right")))
        out[i:j] = span_hashes(data[starts[i]: ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term hash, occurrences) for each term of each document, by document, and each document's term count."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _lower[np.frombuffer(b"\0".join(raw), np.uint8)]
    first = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    starts, ends = word_spans(data, _is_term)
    doc = np.searchsorted(first, starts, "right") - 1
    h = _hashes(data, starts, ends)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    return doc[at], h[at], np.diff(np.append(at, len(h))), np.bincount(doc, minlength=len(raw))


def _keys(h: np.ndarray, level: int) -> np.ndarray:
    return mix64(h + U64((level + 1) * _LEVEL % 2 ** 64))


def _probes(keys: np.ndarray, width: int) -> np.ndarray:
    """(PROBES, n) places in a signature of ``width`` bits."""
    step = (keys >> U64(32)) | U64(1)
    return (((keys & U64(0xFFFFFFFF))[None, :] + np.arange(PROBES, dtype=U64)[:, None] * step[None, :]) % U64(width)).astype(np.int64)


_INDEX = pa.schema([("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                    ("slices", pa.binary()), ("terms", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int64()))])
INDEX = "width int, ids array<long>, hashes array<long>, sizes array<long>, slices binary, terms array<long>, dfs array<long>"


def _block(width: int, held: list[tuple]) -> pa.RecordBatch:
    ids, hashes, sizes, keys = zip(*held)
    padded = -(-len(ids) // 8) * 8
    bits = np.zeros(width * padded, bool)
    column = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
    for p in _probes(np.concatenate(keys), width):
        bits[p * padded + column] = True
    slices = np.packbits(bits.reshape(width, padded), axis=1, bitorder="little").tobytes()
    return pa.RecordBatch.from_pydict({"width": [width], "ids": [ids], "hashes": [hashes], "sizes": [sizes], "slices": [slices], "terms": [None], "dfs": [None]}, schema=_INDEX)


def _statistics(counts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    h, at = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([c[1] for c in counts])).astype(np.int64)
    for i in range(0, len(h), 1 << 16):
        part = {"terms": [h[i: i + (1 << 16)].view(np.int64)], "dfs": [n[i: i + (1 << 16)]]}
        yield pa.RecordBatch.from_pydict({**{f.name: [None] for f in _INDEX}, **part}, schema=_INDEX)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {}
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    counted = 0
    for b in batches:
        ids, hashes = b.column("doc_id").to_pylist(), b.column("th").to_pylist()
        for first, texts in by_size(t or "" for t in b.column("text").to_pylist()):
            doc, h, tf, size = term_counts(texts)
            if not len(h):
                continue
            counts.append(np.unique(h, return_counts=True))
            counted += len(counts[-1][0])
            if counted > COUNTED:
                yield from _statistics(counts)
                counts, counted = [], 0
            level = np.minimum(np.log2(tf).astype(int), LEVELS - 1)
            keys = [_keys(h[level >= k], k) for k in range(int(level.max()) + 1)]
            owner = np.concatenate([doc[level >= k] for k in range(len(keys))])
            order = np.argsort(owner, kind="stable")
            cuts = np.cumsum(np.bincount(owner, minlength=len(texts)))
            parts = np.split(np.concatenate(keys)[order], cuts[:-1])
            for i, k in enumerate(parts):
                if not len(k):
                    continue
                width = int(np.ceil(BITS * 2 ** (np.ceil(2 * np.log2(len(k))) / 2)))
                group = held.setdefault(width, [])
                group.append((ids[first + i], hashes[first + i], int(size[i]), k))
                if len(group) >= max(8, min(ROWS, BLOCK_BITS // width // 8 * 8)):
                    yield _block(width, held.pop(width))
    for width, group in held.items():
        yield _block(width, group)
    if counts:
        yield from _statistics(counts)


@dataclass
class Index:
    """``blocks`` (width, ids, hashes, sizes, slices), ``terms`` (term hash, df), and the totals of documents with terms and
    of terms."""

    blocks: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))


def build_index(docs: DataFrame) -> Index:
    """The index of ``docs`` (doc_id, text), written to the shared folder."""
    table = scratch(_texts(docs).mapInArrow(_index_rows, INDEX), "bit-slices")
    blocks = table.where("width IS NOT NULL").drop("terms", "dfs")
    terms = table.where("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("h"), F.col("x.dfs").alias("df"))
    n, total = blocks.agg(F.sum(F.size("ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    return Index(blocks, terms, n or 0, total or 0)


class QueryBlock:
    """A block of items: numbers ``q`` in ascending order, its distinct terms with hash and weight, and each item's terms as
    places among them."""

    def __init__(self, rows: list, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        known = {r["term"]: (r["h"], r["w"]) for r in rows}
        self.terms = {t: i for i, t in enumerate(sorted(known))}
        self.hashes = np.array([known[t][0] for t in self.terms], np.int64).view(U64)
        self.weights = np.array([known[t][1] for t in self.terms], np.int64)
        items: dict[int, list[int]] = {}
        for r in rows:
            items.setdefault(r["q"], []).append(self.terms[r["term"]])
        self.q = np.array(sorted(items), np.int64)
        self.items = [np.array(items[q]) for q in self.q.tolist()]
        self.place = {q: i for i, q in enumerate(self.q.tolist())}

    def norm(self, size):
        return 10 + (90 * size * self.n_docs) // self.n_terms

    def score(self, terms: list[str], wanted: list[int]) -> list[int]:
        """Exact scores of a document's terms for the items ``wanted``."""
        counts = {self.terms[t]: tf for t, tf in Counter(terms).items() if t in self.terms}
        m = self.norm(len(terms))
        part = {i: int(self.weights[i]) * ((10 ** 9 * tf) // (1000 * tf + 8 * m)) for i, tf in counts.items()}
        return [sum(part.get(i, 0) for i in self.items[self.place[q]].tolist()) for q in wanted]

    def bounds(self, width: int, sizes: np.ndarray, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, (items, documents) upper bounds of the scores), a bounded number of cells at a time."""
        n = len(sizes)
        bits = np.frombuffer(slices, np.uint8).reshape(width, -1)
        probes = [_probes(_keys(self.hashes, level), width) for level in range(LEVELS)]
        step = max(8, CELLS // max(1, len(self.hashes)) // 8 * 8)
        for a in range(0, n, step):
            size = sizes[a: a + step]
            m = self.norm(size)
            part = bits[:, a // 8: -(-(a + len(size)) // 8)]
            best = np.zeros((len(self.hashes), len(size)), np.int64)
            left = np.arange(len(self.hashes))
            above = None
            for level in range(LEVELS):
                # tf at most 2^(level+1) - 1; without a limit on the last level
                tf = 2 ** (level + 1) - 1
                factor = 10 ** 9 * tf // (1000 * tf + 8 * m) if level < LEVELS - 1 else np.full(len(size), 10 ** 6, np.int64)
                rows = part[probes[level][0, left]]
                for p in probes[level][1:]:
                    rows &= part[p[left]]
                if above is not None:
                    rows &= above
                some = rows.any(axis=1)
                left, above = left[some], rows[some]
                if not len(left):
                    break
                on = np.unpackbits(above, axis=1, count=len(size), bitorder="little").astype(bool)
                best[left] = np.where(on, factor, best[left])
            best *= self.weights[:, None]
            yield a, np.stack([best[i].sum(axis=0) for i in self.items])


def _bounded(blocks: DataFrame, block, keep) -> DataFrame:
    """(q, doc_id, th, bound) of what ``keep``, a class made in each task, takes from the bounds."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        kept = keep(queries)
        for b in batches:
            for r in range(b.num_rows):
                ids = b.column("ids")[r].values
                no_id = np.asarray(ids.is_null())
                ids = np.asarray(ids.fill_null(0))
                hashes, sizes = np.asarray(b.column("hashes")[r].values), np.asarray(b.column("sizes")[r].values)
                for a, bound in queries.bounds(b.column("width")[r].as_py(), sizes, b.column("slices")[r].as_py()):
                    c = slice(a, a + bound.shape[1])
                    yield from kept.add(bound, ids[c], no_id[c], hashes[c])
        yield from kept.rest()
    return blocks.mapInArrow(rows, "q long, doc_id long, th long, bound long")


def _found(q, ids, no_id, hashes, bound) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=no_id), "th": pa.array(hashes, pa.int64()),
                                       "bound": pa.array(bound, pa.int64())})


def _greatest(k: int):
    """Keeps the k greatest positive bounds of each item in a task."""
    class Greatest:
        def __init__(self, queries: QueryBlock):
            self.q = queries.q
            shape = (len(self.q), k)
            self.bound, self.ids, self.hashes = (np.zeros(shape, np.int64) for _ in range(3))
            self.no_id = np.zeros(shape, bool)

        def add(self, bound, ids, no_id, hashes):
            # only items some bound of which exceeds their least kept
            rows = np.flatnonzero(bound.max(axis=1) > self.bound.min(axis=1))
            if len(rows):
                both = np.concatenate([self.bound[rows], bound[rows]], axis=1)
                best = np.argpartition(-both, k - 1, axis=1)[:, :k]
                old, at = best < k, np.maximum(best - k, 0)
                for mine, theirs in ((self.ids, ids), (self.no_id, no_id), (self.hashes, hashes)):
                    mine[rows] = np.where(old, np.take_along_axis(mine[rows], np.minimum(best, k - 1), axis=1), theirs[at])
                self.bound[rows] = np.take_along_axis(both, best, axis=1)
            return ()

        def rest(self):
            i, j = np.nonzero(self.bound > 0)
            if len(i):
                yield _found(self.q[i], self.ids[i, j], self.no_id[i, j], self.hashes[i, j], self.bound[i, j])
    return Greatest


def _reaching(thresholds: dict[int, int]):
    """Keeps every document whose bound reaches the item's threshold."""
    class Reaching:
        def __init__(self, queries: QueryBlock):
            self.q = queries.q
            self.least = np.array([thresholds.get(q, 1) for q in self.q.tolist()], np.int64)[:, None]

        def add(self, bound, ids, no_id, hashes):
            i, j = np.nonzero(bound >= self.least)
            if len(i):
                yield _found(self.q[i], ids[j], no_id[j], hashes[j], bound[i, j])

        def rest(self):
            return ()
    return Reaching


def _exact(docs: DataFrame, found: DataFrame, block) -> DataFrame:
    """(q, doc_id, score) of every row of ``docs`` that ``found`` (q, doc_id, th) names, where the score is above 0."""
    wanted = scratch(found.groupBy("doc_id", "th").agg(F.collect_set("q").alias("qs")), "bit-slices-found")
    other = wanted.withColumnsRenamed({"doc_id": "f_id", "th": "f_th"})
    met = docs.join(other, docs["doc_id"].eqNullSafe(other["f_id"]) & (docs["th"] == other["f_th"])).select("doc_id", "text", "qs")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, text, qs in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("qs").to_pylist()):
                for q, s in zip(qs, queries.score(terms_of(text), qs)):
                    if s > 0:
                        out[0].append(q)
                        out[1].append(i)
                        out[2].append(s)
            yield pa.RecordBatch.from_pydict({c: pa.array(o, pa.int64()) for c, o in zip(("q", "doc_id", "score"), out)})
    return met.mapInArrow(rows, "q long, doc_id long, score long")


def query_terms(queries: DataFrame) -> DataFrame:
    """q (a number for each distinct item), item_id, term, h; one row for each distinct term of an item."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, i, text in zip(*(b.column(c).to_pylist() for c in ("q", "item_id", "text"))):
                terms = sorted(set(terms_of(text)))
                raw = [t.encode("utf-8", "surrogatepass") for t in terms]
                ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
                h = _hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends).view(np.int64) if raw else np.empty(0, np.int64)
                yield pa.RecordBatch.from_pydict({"q": pa.array([q] * len(raw), pa.int64()), "item_id": pa.array([i] * len(raw), pa.int64()),
                                                  "term": pa.array(terms, pa.string()), "h": pa.array(h, pa.int64())})
    items = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return scratch(items.withColumn("q", F.monotonically_increasing_id()).mapInArrow(rows, "q long, item_id long, term string, h long"), "query-terms")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, index: Index | None = None, query_terms_at_once: int = QUERY_TERMS) -> DataFrame:
    """``docs`` (doc_id, text) ranked for each item of ``queries`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    index = index or build_index(docs)
    out = spark.createDataFrame([], "q long, doc_id long, score long")
    asked = query_terms(queries)
    total = asked.count()
    if total and index.n_docs:
        df = index.terms.join(asked.select("h").distinct(), "h").groupBy("h").agg(F.sum("df").alias("df"))
        weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
        weighed = scratch(asked.join(df, "h").withColumn("w", weight), "weights")
        parts = -(-total // query_terms_at_once)
        texts = _texts(docs)
        for part in range(parts):
            rows = weighed.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).select("q", "term", "h", "w").collect()
            if not rows:
                continue
            block = spark.sparkContext.broadcast(QueryBlock(rows, index.n_docs, index.n_terms))
            best = Window.partitionBy("q").orderBy(F.desc("bound"))
            first = _bounded(index.blocks, block, _greatest(k)).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
            order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
            kth = _exact(texts, first, block).withColumn("n", F.row_number().over(order)).where(F.col("n") == k)
            thresholds = {r["q"]: r["score"] for r in kth.select("q", "score").collect()}
            out = out.unionByName(_exact(texts, _bounded(index.blocks, block, _reaching(thresholds)), block))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item_id").distinct(), "q").select("item_id", "rank", "doc_id", "score")
