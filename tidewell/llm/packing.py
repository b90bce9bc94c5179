"""Best-fit packing of token pieces into sequences, online and in bounded space.

A packer has at most ``open_bins`` open bins. Its bitset has bit f set when some open bin has f tokens free; a piece
goes to the lowest set bit at or above its length, that is the open bin it fits best. When too many bins are open, the
fullest (the lowest set bit) closes first.

Each task packs its share of the pieces, in the order of a hash. What a task leaves open at its end is packed again,
with the open bins of other tasks, in rounds of ever fewer tasks, so the waste is that of at most ``fan_in`` * open_bins
bins in the whole corpus plus what the closed bins lack.

Defined results: a null text counts as empty and gives one piece, the end id; a document longer than ``length`` is cut
into pieces of ``length``, the last may be shorter; rows with equal doc_id are packed each on its own; no documents, no
pieces. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, tasks
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, open boolean"


class Packer:
    """``add(length)`` -> (bin, offset). ``open_bins`` bounds the bins that can still take pieces."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most = size, open_bins
        self.bits = self.count = self.next = 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, b = self.size, self.next
            self.next += 1
        if left := free - length:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.count += 1
        return b, self.size - free

    def _take(self, free: int) -> int:
        b = self.by_free[free].pop()
        self.count -= 1
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return b

    def still_open(self) -> np.ndarray:
        return np.array([b for bins in self.by_free for b in bins], np.int64)


def cut(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    end = struct.pack("<I", end_id)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            ids = [enc.ids_bytes(t.as_py()) + end for t in b.column("text")]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            parts = -(-n // length)
            row = np.repeat(np.arange(len(ids)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * length
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(np.minimum(length, n[row] - start), pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[r][4 * s: 4 * (s + length)]) for r, s in zip(row.tolist(), start.tolist())], pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


def _packing(length: int, open_bins: int, round_: int, last: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = Packer(length, open_bins), []
        first = (round_ << 56) | (TaskContext.get().partitionId() << 32)
        for b in batches:
            places = np.array([packer.add(n) for n in b.column("length").to_pylist()], np.int64).reshape(-1, 2)
            held.append((b, places))
            # rows whose bin is closed by now can go; the others wait, at most length pieces for each open bin
            if sum(x.num_rows for x, _ in held) > 4 * open_bins * 32:
                held, done = _split(held, packer.still_open())
                yield from (_rows(x, p, first, False) for x, p in done)
        still = packer.still_open()
        held, done = _split(held, still)
        yield from (_rows(x, p, first, False) for x, p in done)
        yield from (_rows(x, p, first, not last) for x, p in held)
    return pack


def _split(rows, still):
    is_open = [np.isin(p[:, 0], still) for _, p in rows]
    part = lambda keep: [(x.filter(pa.array(m)), p[m]) for (x, p), m in zip(rows, keep) if m.any()]
    return part(is_open), part([~m for m in is_open])


def _rows(b: pa.RecordBatch, places: np.ndarray, first: int, still_open: bool) -> pa.RecordBatch:
    n = b.num_rows
    return pa.RecordBatch.from_arrays(
        [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(places[:, 0] + first, pa.int64()),
         pa.array(places[:, 1], pa.int64()), pa.array(np.full(n, still_open))],
        names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"])


def pack(pieces: DataFrame, length: int = 2048, open_bins: int = 1024, fan_in: int = 32) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` must be a table (it is read once in each round's job)."""
    n, round_, done, left = tasks(pieces.sparkSession), 0, [], pieces
    while True:
        last = n == 1
        key = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_))
        dealt = left.repartition(n, key).sortWithinPartitions(key, "doc_id", "piece")
        packed = scratch(dealt.mapInArrow(_packing(length, open_bins, round_, last), PACKED), f"packed{round_}")
        done.append(packed.where(~F.col("open")))
        if last:
            break
        left = packed.where("open").select("doc_id", "piece", "start", "length", "ids_crc32")
        n, round_ = max(1, n // fan_in), round_ + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("open")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, open_bins: int = 1024) -> DataFrame:
    return pack(scratch(cut(docs, tokenizer, length, end_id), "pieces"), length, open_bins)
