"""Alignment of two tokenizers' tokens by merge-path partitioning of their end offsets.

Both tokenizers' tokens cover the same bytes (a space and the text), so each is an ascending list of end offsets. Merging two
ascending lists is a path through a grid; the diagonals i + j = d cut it into pieces of equal work, and a binary search on a
diagonal finds where the path crosses it. A task lays the documents of a chunk end to end, which makes two ascending lists
for all of them, cuts the path every `STEP` steps whatever the documents' sizes, and walks all pieces at once, each on its
own: a step takes the lesser end (A's first, if equal) and emits the two tokens that overlap up to it, or, where B's end
equals A's, a group's border. A group that crosses pieces is stitched by laying their borders in the pieces' order; the end of
a document is always a border, so no group crosses documents.

Links of a chunk are numbered by its distinct id pairs. Only those pairs and their counts are shuffled: Spark adds them up,
finds the highest count of each B id (a table of at most one row for each id of B, broadcast by that bound), and sends the
pairs' counts back to their chunks, where the documents' links, kept by number, meet them. A pair occurs once in a chunk at
most, so a pair in a third of all links costs one row for each chunk. A chunk is about `CHUNK_CHARS` characters (a longer
text is a chunk of its own), so no task or group holds more.

A is a tokenizers JSON file of byte-level BPE (texts of settled characters are encoded by the same vocabulary as tiktoken
ranks), B a sentencepiece model that adds a space before the text; neither adds special
tokens, and their strings in a text are plain text. Defined results: null and empty texts, and texts whose joined token bytes
under A or B differ from a space and the text (as where a tokenizer normalises), have no tokens: zeros and an empty string. Every
row counts, repeated rows too; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import tiktoken  # noqa: E402
import zstandard  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from .common import by_size, scratch  # noqa: E402

#: Steps of a piece of the merge path; characters of a chunk, and of the texts that are encoded together, about.
STEP = 64
CHUNK_CHARS, TOGETHER = 1 << 21, 1 << 17
BYTE = re.compile("<0x([0-9A-F]{2})>")
#: Fixed value: the split pattern of byte-level BPE files with ``use_regex``.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of Latin, Greek, Cyrillic, Kana and the main Han block, of general punctuation and ASCII with its usual white space:
#: characters whose class no version of Unicode has changed since, so every regular-expression library splits them alike.
SETTLED = re.compile("[\t\n\r -~\u00a0-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u2030-\u203a\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5]*")


def cross_diagonals(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """Where the merge path of the ascending ``a`` and ``b`` (equal values: a's first) crosses each diagonal: how many of
    ``a`` are among the first d of the merged list. All binary searches go on together."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        i = (low + high) // 2
        j = diagonals - 1 - i
        open_ = low < high
        # a[i] comes before b[j]: the crossing lies behind i
        before = open_ & (a[np.minimum(i, len(a) - 1)] <= b[np.clip(j, 0, len(b) - 1)])
        low = np.where(before, i + 1, low)
        high = np.where(open_ & ~before, i, high)
    return low


def merge(a: np.ndarray, b: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps and groups of two tokenisations with the ascending end offsets ``a`` and ``b`` (last ends equal): the a and b
    tokens of every overlapping pair, in path order, and of every group the number of a and b tokens up to its end."""
    total = len(a) + len(b)
    if not total:
        none = np.empty(0, np.int64)
        return none, none, none, none
    diagonals = np.arange(0, total, step)
    i = cross_diagonals(a, b, diagonals)
    j = diagonals - i
    left = np.minimum(diagonals + step, total) - diagonals
    never = np.int64(np.iinfo(np.int64).max)
    a_end, b_end = np.append(a, never), np.append(b, never)
    # (step, piece) tables, read piece by piece afterwards
    shape = (min(step, total), len(diagonals))
    at_a, at_b, what = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int8)
    for s in range(shape[0]):
        x, y = a_end[i], b_end[j]
        takes_a = x <= y
        border = ~takes_a & (i > 0) & (a_end[i - 1] == y)
        live = s < left
        at_a[s], at_b[s] = i, j
        what[s] = np.where(live, np.where(border, 2, 1), 0)
        i = i + (live & takes_a)
        j = j + (live & ~takes_a)
    at_a, at_b, what = at_a.T.ravel(), at_b.T.ravel(), what.T.ravel()
    link, cut = what == 1, what == 2
    return at_a[link], at_b[link], at_a[cut], at_b[cut] + 1


class Sides:
    """Both tokenizers, the byte lengths and bytes of their tokens, and the texts of ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        self.quick = self._quick(a_path, letters)
        self.a_bytes = [b""] * (1 + max(max(vocabulary.values()), max(self.a.get_vocab().values())))
        for t, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in t) if t in vocabulary and all(c in letters for c in t) else t.encode("utf-8")
        self.b = SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # each id's text with the sign that may follow it
        self.a_text, self.b_text = (np.array([f"{i}{s}".encode() for s in signs for i in range(len(side))], object)
                                    for side, signs in ((self.a_bytes, (",", "|")), (self.b_bytes, (",", ";"))))

    @staticmethod
    def _quick(path: str, letters: dict[str, int]) -> tiktoken.Encoding | None:
        """The same vocabulary as ranks, which encode several times faster, if the file is plain byte-level BPE whose ids
        follow the order of its merges."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, before = whole["model"], whole["pre_tokenizer"] or {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"].get("".join(m), -1) for m in pairs]
        plain = (whole["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
                 and not model.get("ignore_merges") and not model.get("dropout") and len(model["vocab"]) == 256 + len(pairs))
        if not plain or ids != sorted(set(ids)) or ids[:1] != [256]:
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
        return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        """A's ids of a space and each text; texts of settled characters by ranks, all others by the tokenizers library."""
        quick = [self.quick is not None and SETTLED.fullmatch(t) is not None for t in texts]
        slow = iter(self.a.encode_batch([" " + t for t, q in zip(texts, quick) if not q], add_special_tokens=False))
        return [self.quick.encode_ordinary(" " + t) if q else next(slow).ids for t, q in zip(texts, quick)]

    @staticmethod
    def _piece(piece: str) -> bytes:
        m = BYTE.fullmatch(piece)
        return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode("utf-8")

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each text; none where the bytes do not come back."""
        a = self.a_ids(texts)
        b = self.b.encode(texts, num_threads=1)
        for n, t in enumerate(texts):
            raw = (" " + t).encode("utf-8")
            if not t or b"".join(map(self.a_bytes.__getitem__, a[n])) != raw or b"".join(map(self.b_bytes.__getitem__, b[n])) != raw:
                a[n], b[n] = [], []
        return a, b


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level BPE writes each byte -> the byte: printable Latin-1 stands for itself, the other bytes
    follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + n): b for n, b in enumerate(others)}}


_sides: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    """One per worker process and pair of files."""
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = Sides(a_path, b_path)
    return _sides[a_path, b_path]


def _ravel(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class Aligned:
    """Documents aligned together: token ids and counts, links as id pairs with their document, and groups as text."""

    def __init__(self, both: Sides, a: list[list[int]], b: list[list[int]], step: int = STEP):
        ids_a, self.n_a = _ravel(a)
        ids_b, self.n_b = _ravel(b)
        i, j, end_a, end_b = merge(np.cumsum(both.a_sizes[ids_a]), np.cumsum(both.b_sizes[ids_b]), step)
        doc_a = np.repeat(np.arange(len(a)), self.n_a)
        self.pairs = ids_a[i] << 32 | ids_b[j]
        self.doc = doc_a[i]
        self.n_links = np.bincount(self.doc, minlength=len(a))
        self.n_groups = np.bincount(doc_a[end_a - 1], minlength=len(a))
        self.texts = self._texts(both, ids_a, ids_b, end_a, end_b)

    def _texts(self, both: Sides, ids_a, ids_b, end_a, end_b) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document: A's tokens of a group come before B's."""
        start_a, start_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[end_a - 1] = 1
        last_b[end_b - 1] = 1
        out = np.empty(len(ids_a) + len(ids_b), object)
        out[np.arange(len(ids_a)) + np.repeat(start_b, end_a - start_a)] = both.a_text[ids_a + last_a * len(both.a_bytes)]
        out[np.arange(len(ids_b)) + np.repeat(end_a, end_b - start_b)] = both.b_text[ids_b + last_b * len(both.b_bytes)]
        cuts = np.cumsum(self.n_a + self.n_b)
        return [b"".join(part.tolist())[:-1] for part in np.split(out, cuts[:-1])]


def groups(both: Sides, text: str | None) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: A's ids and B's ids."""
    a, b = both.ids([text or ""])
    line = Aligned(both, a, b).texts[0].decode()
    return [tuple([int(x) for x in side.split(",")] for side in g.split("|")) for g in line.split(";")] if line else []


_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
CHUNK = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, "
         "pairs array<long>, counts array<long>")


def _numbered(number: np.ndarray) -> bytes:
    """A document's links, as numbers of pairs: the distinct numbers, by difference, and how often each."""
    at, n = np.unique(number, return_counts=True)
    return zstandard.compress(np.concatenate([np.diff(at, prepend=0), n]).astype("<u4").tobytes(), 1)


def _read_links(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(data), "<u4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2:]


def _aligned_rows(a_path: str, b_path: str, chunk_chars: int, step: int):
    def chunk_rows(number: int, docs: list[tuple], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = [len(p) for p in parts]
        pairs, at, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        links = [_numbered(x) if len(x) else None for x in np.split(at, np.cumsum(sizes)[:-1])]
        columns = list(zip(*docs))
        none = [None] * len(docs)
        yield pa.RecordBatch.from_pydict(dict(zip(_CHUNK.names, ([number] * len(docs), *columns, links, none, none))), schema=_CHUNK)
        for i in range(0, len(pairs), 1 << 16):
            row = {**{n: [None] for n in _CHUNK.names}, "chunk": [number], "pairs": [pairs[i: i + (1 << 16)]], "counts": [counts[i: i + (1 << 16)]]}
            yield pa.RecordBatch.from_pydict(row, schema=_CHUNK)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        docs, parts, held = [], [], 0
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for first, texts in by_size((t or "" for t in b.column("text").to_pylist()), TOGETHER):
                size = sum(map(len, texts))
                if docs and held + size > chunk_chars:
                    yield from chunk_rows(number, docs, parts)
                    number, docs, parts, held = number + 1, [], [], 0
                done = Aligned(both, *both.ids(texts), step)
                held += size
                sha = [hashlib.sha256(t).hexdigest() if t else "" for t in done.texts]
                docs += zip(ids[first: first + len(texts)], done.n_a.tolist(), done.n_b.tolist(), done.n_groups.tolist(), done.n_links.tolist(), sha)
                parts += np.split(done.pairs, np.cumsum(done.n_links)[:-1])
        if docs:
            yield from chunk_rows(number, docs, parts)
    return rows


@dataclass
class Alignment:
    """``rows``: each document's chunk, counts, digest and links; ``chunk_pairs``: chunk, place, pair, n; ``pairs``: pair, count,
    best (whether no other pair of its B id has a higher count)."""

    rows: DataFrame
    chunk_pairs: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, chunk_chars: int = CHUNK_CHARS, step: int = STEP) -> Alignment:
    """Align the tokens of every text of ``docs`` (doc_id, text) and count the linked id pairs (A's id << 32 | B's id)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = scratch(texts.mapInArrow(_aligned_rows(a_path, b_path, chunk_chars, step), CHUNK), "aligned")
    rows = table.where("pairs IS NULL").drop("pairs", "counts")
    found = table.where("pairs IS NOT NULL").select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    counted = scratch(found.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counted.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))
    # at most one row for each id of B
    pairs = counted.join(F.broadcast(highest), b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    return Alignment(rows, found, pairs)


def report(docs: DataFrame, a_path: str, b_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row for each row of ``docs``."""
    done = align(docs, a_path, b_path, chunk_chars)
    # merge hints: the plan is the same at every size
    known = done.chunk_pairs.select("chunk", "pair").join(done.pairs.hint("merge"), "pair").select(F.col("chunk").alias("home"), "pair", "count", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def meet(key, rows: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["pair"].to_numpy())
        count, best = known["count"].to_numpy()[order], known["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        sums, bests = [], []
        for data in rows["links"].to_pylist():
            at, n = _read_links(data) if data else (np.empty(0, np.int64),) * 2
            sums.append(int((count[at] * n).sum()))
            bests.append(int((best[at] * n).sum()))
        out = {**{c: rows[c] for c in own}, "count_sum": pa.array(sums, pa.int64()), "n_best": pa.array(bests, pa.int64())}
        return pa.table({c: out[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})

    return done.rows.groupBy("chunk").cogroup(known.groupBy("home")).applyInArrow(meet, schema)
