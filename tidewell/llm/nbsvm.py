"""Quality classifier: naive Bayes support vectors (a linear hinge-loss model on n-gram indicators scaled by class
log-count ratios).

Indicators of a text, hashed to 2^18 features: n-grams (1 to 5) of its collapsed shape (lower, upper, digit, white space
and each other sign), byte trigrams, words and word pairs, and n-grams of repetition (does a word equal the one 1 to 12
places before). The log-count ratio of a feature is log((1 + P) / |P|) - log((1 + N) / |N|) with P and N the numbers of
training texts of either label that have it; these counts cover all training rows and are added up by Spark in tables of
fixed size, in two rounds so that no task gets one row from every other task. The hinge-loss model is fitted by dual
coordinate descent on a bounded sample of training rows (``sample`` of each label, the first by a hash of doc_id), on
the driver; its size does not grow with the data. Scoring is one pass over the texts with a broadcast of 2^18 weights.

Training rows are those with crc32(doc_id as text) mod 3 other than 1 and a label; nothing but the text enters a score.
Defined results: null and empty texts have no indicator and get the score of the bias; without training rows of both
labels every score is 0.5; a doc_id with several labels takes the largest; a null doc_id is not held out and not trained
on. Extra columns are ignored by `scores` and pass through `good_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, add_tables, packed, scratch, span_hashes, unpacked, with_found, word_spans

BITS = 18
SIZE = 1 << BITS
LAGS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)
SAMPLE = 2000
#: Bytes of text looked at together; a longer text is hashed window by window, with all its windows' indicators.
WINDOW = 1 << 18

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_shape = np.arange(256, dtype=np.uint64)
_shape[97:123] = _shape[128:256] = 97
_shape[65:91] = 65
_shape[48:58] = 48
_shape[[9, 11, 12, 32]] = 32


def _slots(x: np.ndarray, salt: int) -> np.ndarray:
    h = (x + U64(salt)) * U64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U64(29))) * U64(0xD6E8FEB86659FD93)
    return (h >> U64(64 - BITS)).astype(np.int32)


def indicators(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The features of a text. ``seen`` is a work array of SIZE falses and is left so."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for a in range(0, len(data), WINDOW):
        b = data[max(0, a - 64): a + WINDOW]
        x = b.astype(np.uint64)
        seen[_slots(x[:-2] | (x[1:-1] << U64(8)) | (x[2:] << U64(16)), 1 << 40)] = True
        shape = _shape[b]
        if len(shape) > 1:
            shape = shape[np.append(True, shape[1:] != shape[:-1])]
        gram = shape
        for n in range(1, 6):
            seen[_slots(gram, n << 41)] = True
            gram = gram[:-1] * U64(257) + shape[n:] if len(shape) > n else gram[:0]
        starts, ends = word_spans(b, ~_space)
        h = span_hashes(b, starts, ends)
        seen[_slots(h, 1 << 50)] = True
        seen[_slots(h[:-1] * U64(3) + h[1:], 1 << 51)] = True
        for lag in LAGS:
            same = (h[lag:] == h[:-lag]).astype(np.uint64)
            if len(same) > 2:
                seen[_slots(same[:-2] + same[1:-1] * U64(2) + same[2:] * U64(4), (1 << 52) + lag)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found.astype(np.int32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def log_count_ratios(counts: np.ndarray, totals: np.ndarray, least: int = 3) -> np.ndarray:
    """From the counts of both labels (2, SIZE); features in fewer than ``least`` texts weigh nothing."""
    r = np.log((counts[1] + 1) / (totals[1] + 2)) - np.log((counts[0] + 1) / (totals[0] + 2))
    return np.where(counts.sum(axis=0) >= least, r, 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, epochs: int = 20, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights of the hinge-loss model with L2 penalty on unit-length rows of ratios, and its bias (a feature of value
    one). Every row's dual variable stays in [0, c]."""
    values = [r[i] / max(1e-9, float(np.sqrt((r[i] ** 2).sum()))) for i in rows]
    w, b, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    q = [float(v @ v) + 1.0 for v in values]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + b) - 1.0
            new = min(max(alpha[i] - gradient / q[i], 0.0), c)
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * values[i]
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights by feature, ratios, bias)"""
    known = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.col("quality").cast("int")).alias("quality")).where(~held_out(F.col("doc_id"))))
    known = scratch(known, "labels")
    order = F.xxhash64(F.lit(11), "doc_id")
    chosen = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample).select(F.col("doc_id").alias("_s")) for q in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    known = known.join(chosen, known["doc_id"] == chosen["_s"], "left").select("doc_id", "quality", F.col("_s").isNotNull().alias("sampled"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, totals = np.zeros(SIZE, bool), np.zeros((2, SIZE), np.uint32), np.zeros(2, np.uint32)
        part = TaskContext.get().partitionId()
        for b in batches:
            out = []
            for text, quality, sampled in zip(b.column("text"), b.column("quality").to_pylist(), b.column("sampled").to_pylist()):
                found, q = indicators(text.as_py(), seen), int(quality > 0)
                counts[q, found] += 1
                totals[q] += 1
                if sampled:
                    out.append((-1 - q, found.astype("<i4").tobytes()))
            yield _rows([k for k, _ in out], part, [v for _, v in out])
        if totals.any():
            for q in (0, 1):
                yield _rows([q], part, [packed(np.append(counts[q], totals[q]))])

    done = scratch(rows.join(known.hint("merge"), "doc_id").select("text", "quality", "sampled").mapInArrow(count, "slab int, part int, data binary"), "counts")
    counts, totals = np.zeros((2, SIZE)), np.zeros(2)
    for q, data in add_tables(done.where("slab >= 0")):
        a = unpacked(data)
        counts[q], totals[q] = a[:-1], a[-1]
    if not totals.all():
        return np.zeros(SIZE), np.zeros(SIZE), 0.0
    r = log_count_ratios(counts, totals)
    picked = [(k, bytes(v)) for k, v in done.where("slab < 0").select("slab", "data").collect()]  # at most 2 * sample rows
    picked.sort()
    w, b = dual_coordinate_descent([np.frombuffer(v, "<i4") for _, v in picked], np.array([1.0 if k == -2 else -1.0 for k, _ in picked]), r)
    return w, r, b


def _rows(slabs, part, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"slab": pa.array(slabs, pa.int32()), "part": pa.array([part] * len(slabs), pa.int32()), "data": pa.array(data, pa.binary())})


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, th (hash of the text), held_out, score, predicted for each row of ``docs``."""
    w, r, b = train(docs, labels, sample)
    model = docs.sparkSession.sparkContext.broadcast(((w * r).astype(np.float32), (r * r).astype(np.float32), b))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, square, bias = model.value
        seen = np.zeros(SIZE, bool)
        for batch in batches:
            found = [indicators(t.as_py(), seen) for t in batch.column("text")]
            margin = np.array([weight[f].sum(dtype=np.float64) / max(1e-9, float(np.sqrt(square[f].sum(dtype=np.float64)))) for f in found]) + bias
            s = 1 / (1 + np.exp(-np.clip(2 * margin, -500, 500)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "th": batch.column("th"), "held_out": batch.column("held_out"),
                                              "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())})

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        score, "doc_id long, th long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those predicted to have the label 0; all columns stay."""
    low = scores(docs, labels, sample).where("predicted = 0").select("doc_id", "th").distinct()
    good, _ = with_found(docs, low, "left_anti")
    return good.select(*(F.col(f"`{c}`") for c in docs.columns))
