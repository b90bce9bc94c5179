"""Token files, their index and packing: round trips against the tokenizers library on its own."""
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import packing as P
from tidewell.llm import token_index as T
from tidewell.llm.common import scratch_dir
from tidewell.llm.tokens import Encoder

from .conftest import texts

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def ids(t):
    return TOK.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXYZ'sÉéßüΣσ́  \x1c\x85 \n\t.,!<|>endoftext019漢😀ǅİ")), max_size=60))
def test_cached_encoder_equals_the_library(t):
    enc = Encoder(PATH, cache=3)
    for _ in range(2):
        assert np.frombuffer(enc.ids_bytes(t), "<u4").tolist() == ids(t)


def test_special_strings_are_the_librarys_business():
    assert np.frombuffer(Encoder(PATH).ids_bytes("a<|endoftext|>b c <|startoftext|>"), "<u4").tolist() == ids("a<|endoftext|>b c <|startoftext|>")


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_perfect_hash_numbers_every_key_once(n):
    h = T.mix64(np.arange(n, dtype=np.uint64) * np.uint64(7919))
    assert sorted(T.PerfectHash.build(h).numbers(h).tolist()) == list(range(n))


def test_index_round_trip(spark, awkward, nothing):
    manifest = T.write_index(awkward, scratch_dir(spark, "index"), PATH).cache()
    rows = T.read_all(manifest, step=500).collect()
    docs = sorted(texts(), key=lambda x: x[0])
    want, start = [], 0
    for d, t in docs:
        x = ids(t) + [1]
        want.append((d, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
    got = sorted(rows, key=lambda r: r["start"])
    assert [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got] == [d for d, _ in docs]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(want)
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    keys = spark.createDataFrame([(i,) for i in (1, 2, 3, 6, 9, 10, 77, -5, None)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in T.lookup(keys, manifest).collect()}
    by = {(None if d < 0 else d): t for d, t in docs}
    assert found == {k: (ids(by[k]) + [1] if k in by else None) for k in (1, 2, 3, 6, 9, 10, 77, -5, None)}
    assert T.index_documents(spark, nothing, PATH).count() == 0


def test_foreign_keys_are_refused(spark):
    df = spark.range(3000).selectExpr("id * 2 AS doc_id", "'a b' AS text")
    manifest = T.write_index(df, scratch_dir(spark, "index"), PATH)
    rows = T.lookup(spark.range(6000).selectExpr("id AS doc_id"), manifest).collect()
    assert all((r["ids"] is not None) == (r["doc_id"] % 2 == 0) for r in rows)


def check_packed(rows, docs, length):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for d, t in docs:
        x = ids(t) + [0]
        for n, a in enumerate(range(0, len(x), length)):
            p = x[a: a + length]
            want.setdefault(d, []).append((n, a, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= length
    return len(bins), sum(p[2] for v in want.values() for p in v)


def test_packing_of_awkward_rows(awkward, nothing):
    rows = P.pack_documents(awkward, PATH, length=64).collect()
    bins, total = check_packed(rows, texts(), 64)
    assert bins <= -(-total // 64) + 2
    assert P.pack_documents(nothing, PATH).count() == 0


def test_packing_is_tight_and_loses_no_piece(spark):
    r = random.Random(5)
    docs = [(i, " ".join("the" for _ in range(r.randrange(400)))) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bins, total = check_packed(P.pack_documents(df, PATH, length=512, open_bins=64).collect(), docs, 512)
    assert bins <= 1.03 * total / 512 + 1


def best_fit(lengths, size, most):
    """Plain bounded-space best fit: the fullest bin that still fits; too many open, the fullest closes."""
    bins, out, n = [], [], 0  # open bins as [used, number]
    for x in lengths:
        fits = [b for b in bins if size - b[0] >= x]
        if fits:
            b = max(fits)
        else:
            if len(bins) >= most:
                bins.remove(max(bins))
            b = [0, n]
            n += 1
            bins.append(b)
        out.append(b[0])
        b[0] += x
        if b[0] == size:
            bins.remove(b)
    return out, n


def test_packer_takes_the_best_fit():
    r = random.Random(6)
    lengths = [r.randrange(1, 101) for _ in range(2000)]
    packer = P.Packer(100, 7)
    got = [packer.add(x)[1] for x in lengths]
    want, n = best_fit(lengths, 100, 7)
    assert got == want and packer.next == n


def test_ids_that_need_more_bytes(spark, tmp_path):
    import public_tokenizers
    from tidewell.llm import token_index as T
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    wide = T.write_index(docs, str(tmp_path / "wide"), path, end_id=70_000)
    assert wide.agg({"n_ids": "sum"}).first()[0] == 4
    files = [f for f in (tmp_path / "wide").iterdir() if f.suffix == ".bin"]
    data = b"".join(f.read_bytes()[len(T.MAGIC):] for f in files)
    assert (70_000).to_bytes(4, "little") in data
    with pytest.raises(Exception, match="does not fit 2 bytes"):
        T.write_index(docs, str(tmp_path / "narrow"), path, end_id=70_000, id_bytes=2).count()
