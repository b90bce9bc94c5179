"""M-trees, source mixing and language-model scores against brute force."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import context_mixing as C
from tidewell.llm import mixing, mtree
from tidewell.llm.common import Squeezed, opens

from .conftest import AWKWARD


# ---------------------------------------------------------------- M-tree

def brute(ids, x, q, own, k):
    s = x @ q
    rows = sorted(((-int(a), int(i)) for a, i in zip(s, ids) if i != own))
    return [(-a, i) for a, i in rows[:k]]


@pytest.mark.parametrize("page", [4, 16, 1024])
def test_tree_finds_what_a_scan_finds(page):
    r = np.random.default_rng(page)
    x = np.floor(64 * r.normal(size=(900, 6)) * 0.4)
    x[100:400] = x[100]  # a third of the rows alike
    ids = r.permutation(900)
    tree = mtree.MTree(ids, x, page)
    for (s, i), j in zip(tree.top(x[:40], ids[:40], 20), range(40)):
        assert list(zip(s.astype(int).tolist(), i.tolist())) == brute(ids, x, x[j], ids[j], 20)


def test_tree_skips_distances_on_clustered_vectors(monkeypatch):
    r = np.random.default_rng(0)
    centres = r.normal(size=(20, 8)) * 400
    x = np.floor(np.repeat(centres, 100, axis=0) + r.normal(size=(2000, 8)) * 3)
    tree = mtree.MTree(np.arange(2000), x, 16)
    kept = []
    monkeypatch.setattr(mtree.MTree, "_keep", staticmethod(lambda found, worst, j, scores, ids, k, keep=mtree.MTree._keep: (kept.append(len(scores)), keep(found, worst, j, scores, ids, k))))
    tree.top(x[:1], np.array([0]), 5)
    assert sum(kept) < 700


def test_search_every(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.normal(size=5)]) for i in range(300)]
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0, 0.0]), (340, [1.0, float("nan"), 0.0, 0.0, 0.0]), (360, [float("inf")] * 5), (380, []), (None, [1.0] * 5),
             (400, [0.5, 0.5]), (401, [0.25, -0.25]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("extra")).withColumn("score", F.lit(1))
    got = defaultdict(list)
    for x in mtree.search_every(df, 20, 4).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    fine = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64))) for i, v in rows if i is not None and v and all(a is not None and np.isfinite(a) for a in v)]
    want = {}
    for i, v in fine:
        if i % 20 == 0:
            s = sorted((-int(v @ w), j) for j, w in fine if j != i and len(w) == len(v))[:4]
            want[i] = [(n + 1, j, -a) for n, (a, j) in enumerate(s)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert mtree.search_every(df.limit(0)).count() == 0


def test_blocks_of_queries_and_trees(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in np.floor(r.normal(size=4) * 20)]) for i in range(500)]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = defaultdict(list)
    for x in mtree.top_k(v, v.where("vec_id < 50"), 5, block=60, query_block=9, page=8).collect():
        got[x["query_id"]].append((x["rank"], x["score"], x["vec_id"]))
    ids, m = np.arange(500), np.array([a for _, a in rows])
    assert {k: [t[1:] for t in sorted(a)] for k, a in got.items()} == {i: brute(ids, m, m[i], i, 5) for i in range(50)}


# ---------------------------------------------------------------- mixing

def fill(sizes, weights, total, most=3):
    """Targets by resharing the excess until none is above."""
    capped, target = set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        w = sum(weights[s] for s in free)
        target = {s: most * sizes[s] for s in capped} | {s: rest * weights[s] / w for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 900, "c": 50}, {"a": 5, "b": 5, "c": 5, "d": 10_000}, {"a": 0, "b": 7}, {"a": 10}, {"x": 1, None: 500, "b": 3}])
def test_targets_are_reshared(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_schedule_ranks_and_spread(spark):
    sizes = spark.createDataFrame([(f"s{i}", 1000 * (i + 1)) for i in range(7)], "source string, size long")
    goals = mixing.targets(sizes).coalesce(1)
    slots = sorted((r["slot"], r["src"], r["rank"]) for r in mixing.schedule(spark, goals, block=8).collect())
    seen = Counter()
    for _, s, k in slots:
        assert k == seen[s]
        seen[s] += 1
    assert len({n for n, _, _ in slots}) == len(slots)
    want = {r["src"]: r["target"] for r in goals.collect()}
    total = sum(want.values())
    assert all(seen[s] == -(-int(want[s] + 1e-6) // 8) for s in want)  # every block has its slot
    for upto in (200, 1000, len(slots)):  # low discrepancy: every prefix is near the target shares
        c = Counter(s for n, s, _ in slots if n < upto)
        assert all(abs(c[s] - upto * want[s] / total) <= 10 for s in want)


def test_takes(spark, awkward, nothing):
    r = random.Random(1)
    docs = [(i, " ".join("w" for _ in range(r.randrange(0, 90))), r.choice("aaab") if i % 9 else None) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.takes(df, block=16).collect()
    size = {i: len(t.split()) for i, t, _ in docs}
    by = defaultdict(int)
    for x in rows:
        assert x["size"] == size[x["doc_id"]] and 0 <= x["taken"] <= 3 * x["size"]
        by[x["source"]] += x["taken"]
    assert all(by[x["source"]] == int(x["target"] + 1e-6) for x in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.takes(df.repartition(11), block=16).collect()), key=str)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    copies = Counter(x["doc_id"] for x in mixed.collect())
    assert all(copies[x["doc_id"]] == int(x["taken"] / max(1, x["size"]) + 0.5) for x in mixing.takes(df).collect())
    assert mixing.takes(awkward).count() == len(AWKWARD) and mixing.mixed_documents(awkward).columns == awkward.columns
    assert mixing.takes(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_scheduled_documents(spark, awkward, nothing):
    r = random.Random(6)
    docs = [(i, "  ".join(f"w{j}" for j in range(r.randrange(0, 90))), r.choice("aaab") if i % 9 else None) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.scheduled_documents(df, block=16).collect()
    whole, got = {i: t for i, t, _ in docs}, defaultdict(list)
    for x in rows:
        assert whole[x["doc_id"]].startswith(x["text"])
        got[x["doc_id"]].append(len(x["text"].split()))
    takes = mixing.takes(df, block=16).collect()
    for x in takes:  # the words taken, in whole passes and one that the target may end
        assert sum(got[x["doc_id"]]) == x["taken"] and sum(n < x["size"] for n in got[x["doc_id"]]) <= 1
    order = {}
    for x in sorted(mixing.mix(df, block=16).collect(), key=lambda x: (x["slot"], x["place"])):
        order.setdefault((x["doc_id"], x["pass"]), None)
    assert [i for i, _ in order] == [x["doc_id"] for x in rows]  # the order of the slots
    repeated = mixing.scheduled_documents(df.unionByName(df), block=16).collect()
    assert sum(len(x["text"].split()) for x in repeated) == sum({x["source"]: int(x["target"] + 1e-6) for x in mixing.takes(df.unionByName(df), block=16).collect()}.values())
    assert mixing.scheduled_documents(awkward).columns == awkward.columns and mixing.scheduled_documents(awkward).count() > 0
    assert mixing.scheduled_documents(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_mix_follows_the_schedule(spark, monkeypatch):
    r = random.Random(4)
    docs = [(i, " ".join("w" for _ in range(r.randrange(0, 120))), "abbbcccccc"[i % 10]) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = sorted(mixing.mix(df, block=16).collect(), key=lambda x: (x["slot"], x["place"]))
    size = {i: len(t.split()) for i, t, _ in docs}
    target = {x["source"]: int(x["target"] + 1e-6) for x in mixing.takes(df, block=16).collect()}
    at, ranks, passes = Counter(), defaultdict(list), defaultdict(int)
    for x in rows:
        if not at[x["slot"]]:
            ranks[x["source"]].append(x["rank"])
        assert x["place"] == at[x["slot"]] and x["start"] == passes[x["doc_id"], x["pass"]]  # gapless, in text order
        at[x["slot"]] += x["words"]
        passes[x["doc_id"], x["pass"]] += x["words"]
    for s, n in target.items():
        assert ranks[s] == list(range(-(-n // 16)))  # a source's blocks come in the order of its stream
    assert sum(n < 16 for n in at.values()) <= len(target) and sum(at.values()) == sum(target.values())
    assert all(n <= size[i] for (i, _), n in passes.items())
    # the taken words come out of the slots: without some of them they are fewer
    full = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: full(*a).where("rank % 2 = 0"))
    assert sum(x["taken"] for x in mixing.takes(df, block=16).collect()) == sum(x["words"] for x in rows if x["rank"] % 2 == 0)


@pytest.mark.parametrize("text, n, want", [("a  b\tc ", 2, "a  b"), ("  a b", 1, "  a"), ("a b", 2, "a b"), ("one", 1, "one")])
def test_first_words(spark, text, n, want):
    df = spark.createDataFrame([(text, n)], "t string, n long")
    assert df.select(mixing.first_words(df["t"], df["n"])).first()[0] == want


# ---------------------------------------------------------------- language-model scores

def plain_base(docs):
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["\0end"] for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    train = [i is not None and not h for (i, _), h in zip(docs, held)]
    c = Counter(w for t, k in zip(tokens, train) if k for w in t)
    n = sum(c.values())
    d = n + 0.5 * (len(c) + 1)
    return sorted((str(i), h, len(t), sum(c[w] > 0 for w in t), n, round(sum(float(np.log10((c[w] + 0.5) / d)) for w in t), 6)) for (i, _), t, h in zip(docs, tokens, held))


def got_base(rows):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


def test_base_score_and_edge_rows(awkward, nothing):
    rows = C.scores(awkward).collect()
    assert got_base(rows) == plain_base([(i, t) for i, t, _ in AWKWARD])
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 6}) == 1
    assert C.scores(nothing).count() == 0


def prose(n, seed):
    r = random.Random(seed)
    syllables = [a + b for a in "bcdfglmn" for b in "aeiou"]
    words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    return [(i, " ".join(words[min(299, int(r.paretovariate(0.7)))] for _ in range(r.randrange(20, 200)))) for i in range(n)]


def test_scores_beat_the_base_on_texts_never_seen(spark, monkeypatch):
    monkeypatch.setattr(C, "TOP", 50)  # most words meet their counts by the join
    docs = prose(400, 4)
    rows = C.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert got_base(rows) == plain_base(docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 1.1 * sum(r["base_score"] for r in held)
    shuffled = spark.createDataFrame([(1000 + i, t[::-1]) for i, t in docs[:40]], "doc_id long, text string")
    both = C.scores(spark.createDataFrame(docs, "doc_id long, text string").unionByName(shuffled.where(C.held_out(F.col("doc_id"))))).collect()
    strange = [r["bits_per_byte"] for r in both if r["doc_id"] >= 1000]
    assert min(strange) > max(r["bits_per_byte"] for r in both if r["held_out"] and r["doc_id"] < 1000)


def test_probabilities_add_up_to_one():
    """Over all symbols after one context, and over all spellings by one byte, the model's probabilities sum to one."""
    sample = [C.words_of(t) for _, t in prose(60, 5)]
    m = C.Model(sample)
    wc, bc = m.words.no_counts(), m.bytes.no_counts()
    m.count(C.Tokens(sample), wc, bc)
    m.learn(wc, bc, sample[:20])
    n = len(m.words.code.length)
    some = [np.full(n, c, np.uint32) for c in (0x2545F491, 12345, 999)]
    assert abs(np.exp(-m.words.nats(np.arange(n), some)).sum() - 1) < 1e-3
    some = [np.full(256, c, np.uint32) for c in (7, 77, 777, 7777)]
    assert abs(np.exp(-m.bytes.nats(np.arange(256), some)).sum() - 1) < 1e-3


def test_score_does_not_depend_on_company(monkeypatch):
    sample = [C.words_of(t) for _, t in prose(80, 6)]
    m = C.Model(sample[:40])
    wc, bc = m.words.no_counts(), m.bytes.no_counts()
    m.count(C.Tokens(sample), wc, bc)
    m.learn(wc, bc, sample[:20])
    together = m.log10s(C.Tokens(sample), len(sample))
    monkeypatch.setattr(C, "CHUNK", 50)
    alone = [m.log10s(C.Tokens([t]), 1)[0] for t in sample]
    assert np.allclose(together, alone, rtol=1e-6)


def test_tables_add_up(spark):
    from tidewell.llm.common import add_tables, packed
    rows = [(s, p, packed(np.arange(5) * (s + 1) + p)) for s in range(3) for p in range(200)]
    got = dict(add_tables(spark.createDataFrame(rows, "slab int, part int, data binary").repartition(9)))
    from tidewell.llm.common import unpacked
    for s in range(3):
        assert unpacked(got[s]).tolist() == (np.arange(5) * (s + 1) * 200 + sum(range(200))).tolist()


def test_vocabulary_and_codes_count_all_training_texts(spark):
    docs = prose(300, 4) + [(1000 + i, "minor tongue " * 5) for i in range(4)]  # no bounded sample would hold these four
    counts, total, distinct, letters = C.word_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    m = C.corpus_model(counts, total, letters)
    t = C.Tokens([C.words_of(x) for _, x in docs])
    often = (t.counts >= C.OFTEN) & (np.bincount(np.unique(t.text * len(t.words) + t.word) % len(t.words)) > 1)
    assert total == t.counts.sum() and distinct == len(t.words) and 0 < often.sum() < len(t.words) + 1
    assert ((m.symbols(t.words) != C.ESCAPE) == often).all()
    assert (m.symbols(C.Tokens([b"minor tongue"]).words) != C.ESCAPE).all() and (letters[[ord(c) for c in "minortgue "]] > 0).all()


def test_tables_grow_with_the_contexts(spark, monkeypatch):
    monkeypatch.setattr(C, "WORD_BITS", (6, 6, 6))
    monkeypatch.setattr(C, "BYTE_BITS", (6, 6, 6, 6))
    sample = [C.words_of(t) for _, t in prose(60, 5)]
    m = C.Model(sample)
    df = spark.createDataFrame(prose(60, 5), "doc_id long, text string")
    tables = C.counted(df, m)
    counts, odds = tables.arrays(C.floats, "floats"), tables.arrays(C.odds_of, "odds")
    assert min(m.words.bits[1:]) > 9
    here = [*m.words.no_counts(), *m.bytes.no_counts()]
    m.count(C.Tokens([C.words_of(t) for _, t in prose(60, 5)]), here[:3], here[3:])
    for c, h, o, b in zip(counts, here, odds, m.words.bits + m.bytes.bits):
        assert (c == h).all() and (o == m.words.table(c[0::2], c[1::2])).all()
        assert len(c) == 2 << b and np.count_nonzero(c[0::2] + c[1::2]) < 0.6 * (1 << b)


def test_tables_are_read_from_the_shared_folder_or_come_by_the_driver(spark, monkeypatch):
    df = spark.createDataFrame(prose(80, 5), "doc_id long, text string").repartition(3)
    models = [C.Model([C.words_of(t) for _, t in prose(60, 5)]) for _ in range(3)]
    stored = C.counted(df, models[0])
    assert isinstance(stored, C.Stored)
    there = [a.copy() for a in stored.arrays(C.odds_of, "odds")]
    monkeypatch.setattr(C, "opens", lambda path: False)
    squeezed = C.counted(df, models[1])
    assert isinstance(squeezed, Squeezed)
    for a, b in zip(there, squeezed.arrays(C.odds_of, "odds")):
        assert a.dtype == b.dtype and (a == b).all()
    monkeypatch.undo()
    none = C.counted(df.where("doc_id < 0"), models[2])  # no training row, no slab
    assert not any(a.any() for a in none.arrays(C.floats, "floats"))
    assert opens("file:///tmp/x") and opens("/tmp/x") and not opens("viewfs://store/x")


def test_all_training_texts_are_learnt_from(spark):
    """The sample is a place to start from: with 3 or 512 texts in it, held-out texts score about the same."""
    df = spark.createDataFrame(prose(400, 4), "doc_id long, text string")
    few, many = (sum(r["score"] for r in C.scores(df, sample=n).collect() if r["held_out"]) for n in (3, 512))
    assert abs(few - many) < 0.01 * abs(many), (few, many)


def test_own_counts_are_left_out_and_sums_add_up(spark):
    docs = prose(40, 8)
    sample = [C.words_of(t) for _, t in docs]
    m = C.Model(sample[:20])
    tables, others = [(m.words.no_counts(), m.bytes.no_counts()) for _ in range(2)]
    m.count(C.Tokens(sample), *tables)
    m.count(C.Tokens(sample[1:]), *others)
    m.learn(*tables, sample[:5])
    t = C.Tokens(sample[:1])
    own = m.symbols(t.words)[t.word]
    contexts = m.symbol_contexts(t, own)
    scratch = np.zeros(2 << 22, np.uint32)
    got = np.concatenate([x for x, *_ in m.words.left_out(tables[0], scratch, own, contexts, np.ones(len(own), np.uint32))], axis=1)
    m.words.set_odds(others[0])
    which, k = m.words.code.decisions(own)
    want, _ = m.words._inputs([o.take(C.slots(c, which, m.words.code.salt.take(k), b)) for o, c, b in zip(m.words.odds, contexts, m.words.bits)])
    assert np.allclose(got[:-1], np.stack(want)) and not scratch.any()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for kind in ("slopes", "cells"):
        here = m.sums(list(tables), iter([sample]), kind)
        for a, b in zip(here, C.summed(df, m, spark.sparkContext.broadcast(Squeezed.of([*tables[0], *tables[1]])), kind)):
            assert a.any() and np.allclose(a, b)


def test_long_texts_are_learnt_from_in_steps(monkeypatch):
    """A text taken in several steps gives the sums that it gives in one; so do the slopes by their definition."""
    sample = [C.words_of(t) for _, t in prose(30, 9)] + [C.words_of("")]
    m = C.Model(sample[:20])
    tables = [m.words.no_counts(), m.bytes.no_counts()]
    m.count(C.Tokens(sample), *tables)
    whole = {kind: m.sums(tables, iter([sample]), kind) for kind in ("slopes", "cells")}
    steps = C.steps
    monkeypatch.setattr(C, "steps", lambda n: steps(n, 7))
    for kind, sums in whole.items():
        for a, b in zip(sums, m.sums(tables, iter([sample]), kind)):
            assert a.any() and np.allclose(a, b)
    r = np.random.default_rng(3)
    n, d, gates = 500, *m.words.weights.shape
    x, gate, bit, times = r.normal(size=(d, n)).astype(np.float32), r.integers(0, gates, n), r.integers(0, 2, n), r.integers(1, 4, n)
    got = m.words.slopes(x, gate, gate, bit, times)
    for g in range(gates):
        at = gate == g
        p = 1 / (1 + np.exp(-(m.words.weights[:, g].astype(np.float64) @ x[:, at])))
        curve = (x[:, at] * (times[at] * p * (1 - p))) @ x[:, at].T
        assert np.allclose(got[1: 1 + d, g], x[:, at] @ (times[at] * (p - bit[at])), atol=1e-4)
        assert np.allclose(got[1 + d:, g], curve[np.tril_indices(d)], atol=1e-4)


def test_repeated_query_rows_are_searched_once(spark):
    r = np.random.default_rng(12)
    rows = [(int(i), [float(x) for x in r.normal(size=6)]) for i in [*range(90), 20, 40, 40, 33]]
    rows[-4] = (20, rows[20][1])                 # the same row twice
    other = rows[-3]                             # another vector under the id 40, and that one twice
    rows[-2] = other
    got = mtree.search_every(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    v = [(i, np.floor(64 * np.array(x)).astype(np.int64)) for i, x in rows]
    want = []
    for q, x in {(i, tuple(x.tolist())) for i, x in v if i % 20 == 0}:
        best = sorted((-int(np.dot(x, c)), j) for j, c in v if j != q)[:5]
        want += [(q, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 30


def test_sketches_count_contexts_and_planes_come_back():
    r = np.random.default_rng(3)
    for n in (50, 3000, 200_000):
        reg = np.zeros(1 << C.REGISTER_BITS, np.uint8)
        h = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        rest = 32 - C.REGISTER_BITS
        low = (h & np.uint32((1 << rest) - 1)).astype(np.int64)
        np.maximum.at(reg, (h >> np.uint32(rest)).astype(np.intp), np.array([rest + 1 - int(x).bit_length() for x in low], np.uint8))
        assert abs(C.distinct(reg) / len(np.unique(h)) - 1) < 0.08
    c = r.integers(0, 1 << 60, 1000) * (r.random(1000) < 0.1)
    assert (C._unpacked(C._packed(c)) == c).all()
