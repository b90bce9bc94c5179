"""The registered queries against their SQL, and the pipeline's stages on one another's rows."""
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from tidewell.llm import lsh_forest, mixing, nbsvm, queries
from tidewell.llm.common import scratch
from tidewell.sources.fixtures import read
from tools.check_oracle import canon

SF = "/root/testdata/sf0.01"


def test_one_query_for_each_operator():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    assert got == canon([d[0] for d in cur.description], cur.fetchall())


def test_stages(spark):
    docs = read(spark, SF, "documents")
    frames, df = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        df = scratch(stage(spark, df, SF), f"test-{name}")
        frames.append(df)
    assert [f.columns for f in frames[:-1]] == [docs.columns] * 5
    ids = [[r["doc_id"] for r in f.select("doc_id").collect()] for f in frames]
    bad = {r["doc_id"] for r in nbsvm.scores(docs, read(spark, SF, "labels")).where("predicted = 0").collect()}
    assert set(ids[1]) == set(ids[0]) - bad and len(ids[1]) == len(set(ids[1])) and bad
    left = lsh_forest.near_duplicates(frames[1]).collect()
    assert sorted(ids[2]) == sorted({r["class_id"] for r in left})
    assert sorted(ids[3]) == sorted(ids[2])
    texts = [r["text"] for r in frames[3].select("text").collect()]
    assert not any("AKIA" in (a or "") and a == b for a, b in zip(sorted(texts, key=str), sorted((r["text"] for r in frames[2].select("text").collect()), key=str)))
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in set(ids[4])) <= 3
    assert set(ids[5]) == set(ids[4])
    total = frames[5].groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in total) <= 2048


def run_stages(spark, docs):
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(scratch(stage(spark, frames[-1], SF), f"test-{name}"))
    return frames


def test_stages_on_awkward_rows(spark, awkward):
    """Null ids, texts and sources, empty and very long texts, ties, a repeated row and clashing extra columns."""
    docs = awkward.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    frames = run_stages(spark, docs)
    assert all(f.columns == docs.columns for f in frames[:-1])
    rows = [f.select("doc_id", "text", "source", "n_chars", "row").collect() for f in frames[:-1]]
    assert all(r["row"] == "extra" and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for f in rows for r in f)
    scored = {(r["doc_id"], r["th"]): r["predicted"] for r in nbsvm.scores(docs, read(spark, SF, "labels")).collect()}
    assert len(rows[1]) == sum(scored[r["doc_id"], r["th"]] for r in docs.select("doc_id", F.xxhash64("text").alias("th")).collect())
    near = lsh_forest.near_duplicates(frames[1]).collect()
    assert sorted(str(r["doc_id"]) for r in rows[2]) == sorted({str(r["class_id"]) for r in near})
    assert len(rows[2]) == len(rows[3]) and not any("ann.lee@" in (r["text"] or "").lower() for r in rows[3])
    # the mix: whole words from the start of what the stage before kept, as many of each source as its target
    before = {str(r["doc_id"]): r["text"] or "" for r in rows[3]}
    assert all(before[str(r["doc_id"])].startswith(r["text"]) for r in rows[4])
    goal = {r["source"]: int(r["target"] + 1e-6) for r in mixing.takes(frames[3]).collect()}
    got = dict.fromkeys(goal, 0)
    for r in rows[4]:
        got[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert got == goal
    pieces = frames[5].collect()
    assert {str(p["doc_id"]) for p in pieces} == {str(r["doc_id"]) for r in rows[4]}
    places = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == places.get(p["sequence_id"], 0)
        places[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(places.values()) <= 2048


def test_stages_on_no_rows(spark, nothing):
    docs = nothing.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    frames = run_stages(spark, docs)
    assert [f.count() for f in frames] == [0] * 6 and all(f.columns == docs.columns for f in frames[:-1])
