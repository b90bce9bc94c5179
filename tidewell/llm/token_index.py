"""Token ids of documents in binary shard files, each with a minimal perfect hash index.

Documents go by ranges of doc_id into shards, in ascending doc_id order (null first; equal doc_ids by the hash of the
text). A shard file holds, one after the other: the magic, the ids of all its documents as raw little-endian unsigned
16-bit integers (32-bit if an id needs it), its keys in order, and the index. The index is a minimal perfect hash in
levels: a key takes the slot of the first level where no other key of that level shares its bit, and its number is the
count of set bits before it. By number it stores a 32-bit fingerprint of the key, the place of the document's ids and
their count, so a key costs a constant number of reads and an absent key is refused by the fingerprint. A footer with
the layout closes the file.

Files are written through pyarrow's file systems below the shared folder, under a name of the attempt, and moved to
their name when complete, so a repeated task replaces equal content. One row for each shard, with its path, key range
and counts, is the manifest.

Defined results: null and empty texts have no ids but the end id; a null doc_id is a key of its own; the n-th row with
the same doc_id in a shard has the key (doc_id, n); an empty table has no shards. Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, mix64, open_store, scratch, scratch_dir
from .tokens import encoder

MAGIC = b"TWIDX001"
NO_ID = np.iinfo(np.int64).min
GAMMA = 2.0


# ---------------------------------------------------------------- minimal perfect hash

def key_hashes(ids: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    h = mix64(ids.view(U64) + U64(seed * 0xA24BAED4963EE407 % (1 << 64)))
    return np.where(nth == 0, h, mix64(h ^ mix64(nth.astype(U64) + U64(1))))


class PerfectHash:
    """Number in 0..n-1 for each of n distinct 64-bit hashes."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum([(s + 63) // 64 for s in sizes])]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(h):
            size = max(64, int(GAMMA * len(h)))
            at = cls._places(h, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, bool)
            bits[:size] = alone
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            h = h[~alone[at]]
        return cls(sizes, np.concatenate(words) if words else np.empty(0, "<u8"))

    @staticmethod
    def _places(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(h + U64((level + 1) * 0x9FB21C651E98DF25 % (1 << 64))) % U64(size)).astype(np.int64)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """-1 where no level has the key; a foreign key may get any number."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, size in enumerate(self.sizes):
            at = self._places(h[left], level, size)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(U64)
            value = self.words[word]
            hit = (value >> bit) & U64(1) == 1
            below = np.bitwise_count(value & ((U64(1) << bit) - U64(1)))
            out[left[hit]] = (self.ranks[word] + below)[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


# ---------------------------------------------------------------- shard files

class ShardWriter:
    def __init__(self, path: str, width: int):
        self.path, self.dtype = path, f"<u{width}"
        self.fs, self.name = open_store(path)
        self.part = f"{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.name.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, payloads: list[bytes]) -> None:
        self.ids.append(doc_ids)
        self.counts.append(np.array([len(p) // 4 for p in payloads], np.int64))
        ids = np.frombuffer(b"".join(payloads), "<u4")
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise OverflowError(f"id {int(ids.max())} does not fit {np.dtype(self.dtype).itemsize} bytes")
        self.out.write(ids.astype(self.dtype).tobytes())

    def close(self) -> tuple[int, int, int, int]:
        """(documents, ids, first doc_id, last doc_id)"""
        ids, counts = np.concatenate(self.ids), np.concatenate(self.counts)
        starts = np.cumsum(counts) - counts
        new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        nth = np.arange(len(ids)) - np.repeat(new, np.diff(np.append(new, len(ids))))
        seed = 0
        while len(np.unique(h := key_hashes(ids, nth, seed))) < len(h):
            seed += 1
        index = PerfectHash.build(h)
        order = np.empty(len(ids), np.int64)
        order[index.numbers(h)] = np.arange(len(ids))
        parts = {"doc_id": ids.astype("<i8"), "nth": nth.astype("<u4"), "words": index.words,
                 "fingerprint": (mix64(h[order]) >> U64(32)).astype("<u4"), "start": starts[order].astype("<u8"),
                 "count": counts[order].astype("<u8")}
        at = len(MAGIC) + int(counts.sum()) * np.dtype(self.dtype).itemsize
        layout = {"dtype": self.dtype, "ids": int(counts.sum()), "documents": len(ids), "sizes": index.sizes, "seed": seed, "parts": {}}
        for name, a in parts.items():
            self.out.write(a.tobytes())
            layout["parts"][name] = [at, len(a), a.dtype.str]
            at += a.nbytes
        tail = json.dumps(layout).encode()
        self.out.write(tail + struct.pack("<Q", len(tail)) + MAGIC)
        self.out.close()
        if self.fs.get_file_info(self.name).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.name)
        self.fs.move(self.part, self.name)
        return len(ids), int(counts.sum()), int(ids[0]), int(ids[-1])


class Shard:
    """A shard file: keyed access by the index, payloads read as they are asked for."""

    def __init__(self, path: str):
        fs, name = open_store(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        end = self.file.read_at(16, size - 16)
        if end[8:] != MAGIC:
            raise ValueError(f"{path}: not a complete shard file")
        n = struct.unpack("<Q", end[:8])[0]
        self.layout = json.loads(self.file.read_at(n, size - 16 - n))
        part = {k: np.frombuffer(self.file.read_at(c * np.dtype(t).itemsize, at), t) for k, (at, c, t) in self.layout["parts"].items()}
        self.doc_ids, self.nth = part["doc_id"].astype(np.int64), part["nth"]
        self.index = PerfectHash(self.layout["sizes"], part["words"])
        self.fingerprints, self.starts, self.counts = part["fingerprint"], part["start"].astype(np.int64), part["count"].astype(np.int64)

    def find(self, ids: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and count of each key's ids; count -1 for a key the shard does not have."""
        h = key_hashes(ids, nth, self.layout["seed"])
        n = self.index.numbers(h)
        at = np.maximum(n, 0)
        has = (n >= 0) & (self.fingerprints[at] == (mix64(h) >> U64(32)).astype(np.uint32))
        return np.where(has, self.starts[at], 0), np.where(has, self.counts[at], -1)

    def read(self, start: int, count: int) -> np.ndarray:
        width = np.dtype(self.layout["dtype"]).itemsize
        return np.frombuffer(self.file.read_at(count * width, len(MAGIC) + start * width), self.layout["dtype"])


# ---------------------------------------------------------------- Spark jobs

def write_index(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_bytes: int | None = None) -> DataFrame:
    """Write the shard files of ``docs`` (doc_id, text) to ``folder`` and return the manifest: shard, path, documents,
    n_ids, first_id, last_id and start (ids of all shards before). Ids take ``id_bytes`` (2 or 4), by default as many as the
    vocabulary and the end id need; an id that does not fit fails the job."""
    id_bytes = id_bytes or (2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    end = struct.pack("<I", end_id)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, shard = encoder(tokenizer), None, TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:07d}.bin"
        for b in batches:
            if b.num_rows:
                writer = writer or ShardWriter(path, id_bytes)
                writer.add(b.column("doc_id").fill_null(NO_ID).to_numpy(), [enc.ids_bytes(t.as_py()) + end for t in b.column("text")])
        if writer:
            n, ids, first, last = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "documents": [n], "n_ids": [ids], "first_id": [first], "last_id": [last]})

    text_hash = F.xxhash64("text")
    ordered = (docs.repartitionByRange(F.asc_nulls_first("doc_id"), text_hash)
               .sortWithinPartitions(F.asc_nulls_first("doc_id"), text_hash, "text"))
    manifest = scratch(ordered.mapInArrow(shards, "shard long, path string, documents long, n_ids long, first_id long, last_id long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_all(manifest: DataFrame, step: int = 1 << 20) -> DataFrame:
    """Every key of every shard, looked up through the index: doc_id, start, n_tokens, ids_crc32. A task holds one
    shard's index and about ``step`` ids at a time."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                shard = Shard(m["path"])
                starts, counts = shard.find(shard.doc_ids, shard.nth)
                if (counts < 0).any() or (np.append(starts[1:], shard.layout["ids"]) != starts + counts).any():
                    raise ValueError(f"{m['path']}: the index does not fit its keys")
                group = starts // step
                for first, last in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)))):
                    s, c = starts[first:last], counts[first:last]
                    raw = shard.read(int(s[0]), int(s[-1] + c[-1] - s[0])).astype("<u4").tobytes()
                    at = (s - s[0]) * 4
                    ids = shard.doc_ids[first:last]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "start": pa.array(s + m["start"], pa.int64()),
                        "n_tokens": pa.array(c, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(raw[a: a + 4 * n]) for a, n in zip(at, c)], pa.int64())})

    n = max(1, manifest.count())
    return manifest.select("shard", "path", "start").repartitionByRange(n, "shard").mapInArrow(
        rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """The ids of the given doc_ids (first row of each): doc_id, ids array<int>, null where no shard has the key.
    The driver holds the key ranges of the shards, two numbers for each."""
    shards = manifest.select("shard", "path", "first_id").orderBy("shard").collect()
    firsts = np.array([s["first_id"] for s in shards], np.int64)
    paths = [s["path"] for s in shards]

    @F.pandas_udf("int")
    def route(ids: pd.Series) -> pd.Series:
        # the first row of a doc_id that spans shards lies in the shard before the first that starts with it, or in that
        return pd.Series(np.maximum(np.searchsorted(firsts, ids.to_numpy(), "left") - 1, 0).astype(np.int32))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, Shard] = {}
        for b in batches:
            for r in b.to_pylist():
                found, n = None, r["shard"]
                while paths and found is None and n < min(len(paths), r["shard"] + 2):
                    if n not in opened:
                        opened = {k: opened[k] for k in list(opened)[-3:]} | {n: Shard(paths[n])}
                    s, c = opened[n].find(np.array([r["k"]], np.int64), np.zeros(1, np.int64))
                    found = opened[n].read(int(s[0]), int(c[0])).tolist() if c[0] >= 0 else None
                    n += 1
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r["doc_id"]], pa.int64()), "ids": pa.array([found], pa.list_(pa.int32()))})

    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    routed = keys.select(F.col("doc_id").cast("long").alias("doc_id"), k.alias("k")).withColumn("shard", route("k"))
    return routed.repartition("shard", F.xxhash64("k") % 16).sortWithinPartitions("shard").mapInArrow(rows, "doc_id long, ids array<int>")


def index_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the index of ``docs`` to a new folder of the shared folder and read every document back from the files."""
    return read_all(write_index(docs, scratch_dir(spark, "index"), tokenizer, end_id))
