"""Helpers the operators of this subpackage share: scratch tables, 64-bit mixing, word hashes, batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import checkpoint_dir
from tidewell.sources.fixtures import read

U64 = np.uint64
#: Odd multiplier of the polynomial hashes (arithmetic modulo 2^64), and of the mixers.
BASE = U64(0x9E3779B97F4A7C15)
MIX = U64(0xD6E8FEB86659FD93)
#: Characters (or bytes) handled by one round of array operations; bounds the temporaries of a task.
CHUNK = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return read(spark, sf_dir, "documents")


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a thousand rows at a time, which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to a table in the shared checkpoint folder and read it back: cuts lineage and lets several
    consumers share the work; a lost executor costs a re-read."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there, for tasks that read or write files themselves."""
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    scheme, _, rest = path.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else path)


def opens(path: str) -> bool:
    """Whether tasks can open files there themselves; a store may be open to Spark's readers alone."""
    try:
        open_store(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def stored_rows(path: str) -> Iterator[dict]:
    """The rows of a parquet table that Spark wrote, one at a time, read in a task."""
    fs, name = open_store(path)
    for f in sorted(fs.get_file_info(pafs.FileSelector(name)), key=lambda f: f.path):
        if f.base_name.startswith("part-"):
            with fs.open_input_file(f.path) as opened:
                for b in pq.ParquetFile(opened).iter_batches(batch_size=1, use_threads=False):
                    yield from b.to_pylist()


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixer on uint64 arrays."""
    x = x ^ (x >> U64(32))
    x = x * MIX
    x = x ^ (x >> U64(32))
    x = x * MIX
    return x ^ (x >> U64(32))


def by_size(texts: Iterable[str], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) groups of at most ``most`` characters; a longer text is a group of its own."""
    group: list[str] = []
    first = size = 0
    for i, t in enumerate(texts):
        if group and size + len(t) > most:
            yield first, group
            group, first, size = [], i, 0
        group.append(t)
        size += len(t)
    if group:
        yield first, group


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_found(docs: DataFrame, found: DataFrame, how: str, payload: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """``docs`` joined to ``found`` (doc_id, th, ``keys``, ``payload``) by doc_id, the hash th of the text and the
    ``keys``, nulls equal; and the names of the text hash and the payload there, which clash with no column of docs. A
    sort-merge join at every size: what grows with the data is not broadcast."""
    wide = docs
    names: list[str] = []
    for c in ("th", *payload, "k_id", "k_th", *(f"k_{k}" for k in keys)):
        names.append(fresh(wide, f"_{c}"))
        wide = wide.withColumn(names[-1], F.lit(None))
    th, inner = names[0], names[1:]
    right = found.select(*(F.col(c).alias(n) for c, n in zip((*payload, "doc_id", "th", *keys), inner)))
    d = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    k = len(payload)
    same = d["doc_id"].cast("long").eqNullSafe(right[inner[k]]) & (d[th] == right[inner[k + 1]])
    for key, n in zip(keys, inner[k + 2:]):
        same &= d[key].cast("string").eqNullSafe(right[n])
    return d.join(right.hint("merge"), same, how), names[: 1 + k]


def columns_of(df: DataFrame, docs: DataFrame, added: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` from ``df``, in order, those in ``added`` replaced, and the rest of ``added`` behind."""
    own = [added[c].alias(c) if c in added else F.col(f"`{c}`") for c in docs.columns]
    return df.select(*own, *(v.alias(c) for c, v in added.items() if c not in docs.columns))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0..n-1 and the same powers of its inverse modulo 2^64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        m = max(n, 2 * CHUNK)
        for name, b in (("p", int(BASE)), ("q", pow(int(BASE), -1, 1 << 64))):
            a = np.full(m, b, dtype=U64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=U64)
    return _powers["p"][:n], _powers["q"][:n]


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which the table ``is_word`` (256 booleans) holds."""
    w = np.zeros(len(data) + 2, dtype=np.int8)
    w[1:-1] = is_word[data]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, mixed; equal spans have equal hashes wherever they stand."""
    p, q = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], dtype=U64, out=total[1:])
    return mix64((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct values; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def packed(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype("<u8").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u8")


_spread_out: dict[str, list[np.ndarray]] = {}


class Squeezed:
    """Arrays that travel compressed, by planes of equal byte weight, and are laid out once in each worker process, which
    keeps the last such set only. A broadcast is written to every executor's disk, and tables are mostly zeros."""

    def __init__(self, arrays: list[tuple[str, int, list[bytes]]]):
        """From (dtype, length, compressed parts in order) of each array; `squeeze` makes a part."""
        self.key = uuid.uuid4().hex
        self.parts = arrays

    @classmethod
    def of(cls, arrays: list[np.ndarray], step: int = 1 << 19) -> Squeezed:
        return cls([(a.dtype.str, len(a), [cls.squeeze(a[i: i + step]) for i in range(0, len(a), step)]) for a in arrays])

    @staticmethod
    def squeeze(a: np.ndarray) -> bytes:
        return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 5)

    def arrays(self, turn: Callable[[np.ndarray], np.ndarray] | None = None, name: str = "") -> list[np.ndarray]:
        """The arrays, or what ``turn`` makes of them part by part (``name`` tells such sets apart)."""
        key = f"{self.key} {name}"
        if key not in _spread_out:
            _spread_out.clear()
            out = []
            for dtype, n, parts in self.parts:
                a, at = None, 0
                for p in parts:
                    planes = np.frombuffer(zstandard.decompress(p), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
                    part = np.ascontiguousarray(planes.T).view(dtype).ravel()
                    size = len(part)
                    part = turn(part) if turn else part
                    a = np.empty(n * len(part) // size, part.dtype) if a is None else a
                    a[at: at + len(part)] = part
                    at += len(part)
                out.append(a)
            _spread_out[key] = out
        return _spread_out[key]


def add_tables(partials: DataFrame, fan: int = 64) -> list[tuple[int, bytes]]:
    """The sums of count tables: ``partials`` has (slab, part, data) with the `packed` counts of one slab in one task. Tables are added in two rounds, first by slab and a ``fan``-th of the tasks, and streamed, so a
    task holds one table for each key it meets. What comes back is one row for each slab, of fixed size."""
    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for slab, part, data in zip(b.column("slab").to_pylist(), b.column("part").to_pylist(), b.column("data").to_pylist()):
                a = unpacked(data)
                if (slab, part) in sums:
                    sums[slab, part] += a
                else:
                    sums[slab, part] = a.copy()
        for (slab, part), a in sums.items():
            yield pa.RecordBatch.from_pydict({"slab": pa.array([slab], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([packed(a)], pa.binary())})

    for keep in (fan, 1):
        partials = (partials.withColumn("part", F.pmod(F.col("part"), F.lit(keep)).cast("int")).repartition("slab", "part")
                    .mapInArrow(add, "slab int, part int, data binary"))
    return sorted((r["slab"], bytes(r["data"])) for r in partials.select("slab", "data").collect())
