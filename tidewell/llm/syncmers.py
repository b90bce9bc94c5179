"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest hash of its inner s-mers lies at its first or last place. That
depends on the k-mer alone, so equal passages yield equal anchors at any place of any text, and an edit touches only
the k-mers across it. A fingerprint is the base64 text of the anchors' 32-bit hashes in text order; likeness is the
Jaccard similarity of two fingerprints' distinct hashes.

One k holds for texts of every length, so a fingerprint is a function of the text alone and any two can be compared.

Defined results: a null text counts as empty; an empty text has the fingerprint ""; a text shorter than k has one
anchor, the hash of the whole text; two empty fingerprints are alike (1.0), an empty and another one not (0.0). Rows
with equal doc_id (null: first) follow each other in the order of their texts' hashes. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, CHUNK, U64, by_size, jaccard, mix64, tasks

K, S = 16, 4


def _rolling(h: np.ndarray, width: int, to: int) -> np.ndarray:
    """Hashes of windows of ``to`` items from those of ``width`` items, by doubling."""
    while width < to:
        h = h[:-width] * U64(pow(int(BASE), width, 1 << 64)) + h[width:]
        width *= 2
    return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    span, m = 1, x
    while 2 * span <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def syncmers(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers of an array of code points. k and s are powers of two."""
    if len(codes) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    inner = _rolling(mix64(codes.astype(U64) + U64(1)), 1, s)
    whole = _rolling(inner, s, k)
    inner = mix64(inner)
    w = k - s + 1
    least = _window_min(inner, w)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[w - 1:] == least))
    return at, (mix64(whole[at]) >> U64(32)).astype(np.uint32)


def _spread(texts: list[str], k: int, s: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for _, group in by_size(texts):
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in group], np.int64)
        ends = np.cumsum(sizes)
        found = [syncmers(codes[a: a + CHUNK + k - 1], k, s) for a in range(0, max(1, len(codes)), CHUNK)]
        at = np.concatenate([f[0] + i * CHUNK for i, f in enumerate(found)])
        hashes = np.concatenate([f[1] for f in found])
        doc = np.searchsorted(ends, at, "right")
        inside = at + k <= ends[doc] if len(at) else np.empty(0, bool)
        at, hashes, doc = at[inside], hashes[inside], doc[inside]
        cut = np.searchsorted(doc, np.arange(len(group) + 1))
        for i, t in enumerate(group):
            if 0 < len(t) < k:
                out.append((np.zeros(1, np.int64), np.array([zlib.crc32(t.encode("utf-8", "surrogatepass"))], np.uint32)))
            else:
                out.append((at[cut[i]: cut[i + 1]] - (ends[i] - sizes[i]), hashes[cut[i]: cut[i + 1]]))
    return out


def anchors(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of each text. Work goes by groups of bounded size; a longer text goes by overlapping windows."""
    return _spread(texts, k, s)


def text_of(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and place; the next row of the same bucket is the next document. Rows with ``tail``
    only serve as the next document of the row before them. The last row of a batch is carried over to the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.Table.from_batches([*held, batch])
        held = rows.slice(rows.num_rows - 1).combine_chunks().to_batches()
        yield _results(rows)


def _results(rows: pa.Table) -> pa.RecordBatch:
    texts = [t or "" for t in rows["text"].to_pylist()]
    bucket, tail = rows["bucket"].to_numpy(), rows["tail"].to_numpy()
    todo = np.flatnonzero((tail[:-1] == 0) & (bucket[:-1] == bucket[1:]))
    edited = []
    for i in todo:
        n = len(texts[i]) // 4
        edited.append(texts[i][: len(texts[i]) - n] + texts[i + 1][:n])
    own = [h for _, h in anchors(texts)]
    new = [h for _, h in anchors(edited)]
    sets = [np.unique(h) for h in own]
    return pa.RecordBatch.from_pydict({
        "doc_id": rows["doc_id"].combine_chunks().take(pa.array(todo)),
        "n_chars": pa.array([len(texts[i]) for i in todo], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array([text_of(own[i]) for i in todo], pa.string()),
        "edited_fingerprint": pa.array([text_of(h) for h in new], pa.string()),
        "near_edited": pa.array([jaccard(sets[i], np.unique(h)) for i, h in zip(todo, new)], pa.float64()),
        "near_next": pa.array([jaccard(sets[i], sets[i + 1]) for i in todo], pa.float64()),
    })


def neighbour_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (doc_id, text) with ``bucket`` (ranges of doc_id of about equal counts) and ``tail``: the first rows of
    each bucket stand once more, as tail, in the bucket before (those of the first bucket in the last), so that every
    row meets its successor in its own bucket. What the driver holds is two numbers for each bucket."""
    probs = ",".join(f"{i / buckets:.9f}" for i in range(1, buckets))
    bounds = docs.agg(F.expr(f"percentile_approx(doc_id, array({probs or '0.5'}), {20 * buckets})").alias("b")).first()["b"]
    bounds = np.unique(np.array(bounds or [], np.int64))
    no_id = np.iinfo(np.int64).min

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    key = F.coalesce("doc_id", F.lit(no_id))
    firsts = docs.select(key.alias("k")).select("k", of("k").alias("bucket")).groupBy("bucket").agg(F.min("k").alias("k"))
    firsts = sorted((r["k"], r["bucket"]) for r in firsts.collect())  # at most one row for each bucket
    first_ids = np.array([k for k, _ in firsts], np.int64)
    before = np.array([b for _, b in firsts[-1:] + firsts[:-1]], np.int32)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy()
        own = np.searchsorted(bounds, x, "right")
        at = np.minimum(np.searchsorted(first_ids, x), max(0, len(first_ids) - 1))
        is_first = first_ids[at] == x if len(first_ids) else np.zeros(len(x), bool)
        return pd.Series([[o, before[a]] if f else [o] for o, a, f in zip(own, at, is_first)])

    return (docs.select("doc_id", "text", places(key).alias("p"))
            .select("doc_id", "text", F.posexplode("p").alias("tail", "bucket")))


def compare_with_edited(docs: DataFrame, buckets_per_task: int = 8) -> DataFrame:
    """Per document: its fingerprint, that of its edited text (the last quarter replaced by the start of the next
    document by doc_id), and the likeness to the edited text's and to the next document's fingerprint."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spread = neighbour_buckets(docs, max(2, buckets_per_task * tasks(docs.sparkSession)))
    ordered = spread.repartition("bucket").sortWithinPartitions("bucket", "tail", F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    return ordered.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                               "edited_fingerprint string, near_edited double, near_next double")


def anchor_table(docs: DataFrame) -> DataFrame:
    """(doc_id, position, anchor) of every document, for positional matching by a join on anchor."""
    def rows(batches):
        for b in batches:
            found = anchors([t or "" for t in b["text"]])
            n = [len(p) for p, _ in found]
            yield pd.DataFrame({"doc_id": np.repeat(b["doc_id"].to_numpy(), n),
                                "position": np.concatenate([p for p, _ in found] or [np.empty(0, np.int64)]),
                                "anchor": np.concatenate([h for _, h in found] or [np.empty(0, np.uint32)]).astype(np.int64)})
    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, position long, anchor long")
