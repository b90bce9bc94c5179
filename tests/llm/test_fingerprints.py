"""Closed syncmers against a plain definition; neighbours, edits and likeness against brute force."""
import base64
import hashlib
import random

import numpy as np

from tidewell.llm import syncmers as S

from .conftest import texts


def plain(text, k, s):
    """Places of closed syncmers, by the definition, with the module's hash of an s-mer."""
    codes = np.array([ord(c) for c in text], np.uint32)
    if len(codes) < k:
        return []
    inner = S.mix64(S._rolling(S.mix64(codes.astype(np.uint64) + np.uint64(1)), 1, s)).tolist()
    out = []
    for i in range(len(codes) - k + 1):
        part = inner[i: i + k - s + 1]
        if min(part) in (part[0], part[-1]):
            out.append(i)
    return out


def test_syncmers_follow_the_definition():
    r = random.Random(1)
    for n in (0, 5, 31, 32, 33, 200, 3000):
        t = "".join(r.choice("abc é😀") for _ in range(n))
        at, h = S.syncmers(np.array([ord(c) for c in t], np.uint32), 32, 8)
        assert at.tolist() == plain(t, 32, 8) and len(h) == len(at)


def test_anchors_do_not_depend_on_neighbours_or_windows(monkeypatch):
    r = random.Random(2)
    ts = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (10, 400, 0, 1, 900, 130, 127)]
    whole = S.anchors(ts)
    monkeypatch.setattr(S, "CHUNK", 100)
    for t, (at, h) in zip(ts, whole):
        a2, h2 = S.anchors([t])[0]
        assert at.tolist() == a2.tolist() and h.tolist() == h2.tolist()
    assert len(whole[2][0]) == 0 and len(whole[3][0]) == 1


def test_equal_passages_share_anchors():
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(500))
    a, b = S.anchors(["x" * 77 + passage, passage + "y" * 301])
    assert set(S.anchors([passage])[0][1].tolist()) <= set(a[1].tolist()) & set(b[1].tolist())


def check(rows, docs):
    """rows: results; docs: (id, text) in order."""
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows)
    want = []
    for i, (d, t) in enumerate(docs):
        n = len(t) // 4
        e = t[: len(t) - n] + docs[(i + 1) % len(docs)][1][:n]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert got == sorted(want)


def test_awkward_rows(awkward):
    rows = S.compare_with_edited(awkward).collect()
    check(rows, sorted(texts(), key=lambda x: x[0]))
    by = {}
    for r in rows:
        by.setdefault(r["n_chars"], set()).add(r["fingerprint"])
        h = np.frombuffer(base64.b64decode(r["fingerprint"]), "<u4")
        e = np.frombuffer(base64.b64decode(r["edited_fingerprint"]), "<u4")
        a, b = set(h.tolist()), set(e.tolist())
        assert abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    assert by[0] == {""} and len({r["fingerprint"] for r in rows if r["doc_id"] in (7, 8)}) == 1


def test_long_table_and_empty_table(spark, nothing):
    r = random.Random(4)
    docs = [(i * 3, "".join(r.choice("abcdefghij ") for _ in range(r.randrange(300)))) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    check(S.compare_with_edited(df).collect(), docs)
    assert S.compare_with_edited(nothing).count() == 0
    one = spark.createDataFrame([(1, "only one text here")], "doc_id long, text string")
    assert S.compare_with_edited(one).first()["near_next"] == 1.0


def test_anchor_table(awkward):
    rows = S.anchor_table(awkward).where("doc_id = 7").collect()
    assert [r["position"] for r in rows] == S.anchors(["tie one two three four five six seven"])[0][0].tolist()


def test_fingerprints_depend_on_the_text_alone(spark):
    """Documents and edited texts of lengths around 4k: equal texts have equal fingerprints, likeness is that of the hashes."""
    r = random.Random(5)
    t = "".join(r.choice("abcdefgh ") for _ in range(170))
    docs = [(i, t[:n] if n % 3 else t[::-1][:n]) for i, n in enumerate([*range(90, 171, 4), 130, 0, 5, 15, 16, 17, 64, 98])]
    edited = [x[: len(x) - len(x) // 4] + docs[(i + 1) % len(docs)][1][: len(x) // 4] for i, x in docs]
    docs += [(len(docs) + i, e) for i, e in enumerate(edited)]
    rows = sorted(S.compare_with_edited(spark.createDataFrame(docs, "doc_id long, text string")).collect(), key=lambda x: x["doc_id"])
    prints = {}
    for i, (row, (_, x)) in enumerate(zip(rows, docs)):
        follower = docs[(i + 1) % len(docs)][1]
        e = x[: len(x) - len(x) // 4] + follower[: len(x) // 4]
        for text, f in ((x, row["fingerprint"]), (e, row["edited_fingerprint"])):
            assert prints.setdefault(text, f) == f
        own, new, beside = (set(S.anchors([y])[0][1].tolist()) for y in (x, e, follower))
        for value, other in ((row["near_edited"], new), (row["near_next"], beside)):
            assert abs(value - (len(own & other) / len(own | other) if own | other else 1.0)) < 1e-12
    assert len(prints) < 2 * len(docs)


def test_near_copies_of_any_length_are_alike(spark):
    r = random.Random(5)
    t = "".join(r.choice("abcdefgh ") for _ in range(129))
    docs = [(1, t), (2, t[:127]), (3, t[::-1] + t[:20]), (4, "")]
    got = {x["doc_id"]: x for x in S.compare_with_edited(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["near_next"] > 0.8 and got[3]["near_edited"] > 0.3 and got[3]["near_next"] == 0.0
