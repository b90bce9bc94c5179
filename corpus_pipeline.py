"""The corpus pipeline: each stage calls one operator of tidewell.llm on all rows its predecessor kept.

A stage takes and returns the columns of ``documents``; the last returns the pieces of the packed sequences. ``run``
writes every stage's result to the shared folder as Parquet and reads it back as the next one's input.

Defined results: null, empty and very long texts, null ids and sources, repeated rows and extra columns pass the first three
stages by the rules of their operators (null and empty texts are copies of each other, so one stays; repeated rows are
copies too); documents without words take no part in the mix; no documents give no pieces.

ORACLE_SQL is None: the classifier's fit, the surrogates and the packing order have no SQL form; tests/llm compares the
stages with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import lsh_forest, mixing, nbsvm, packing, surrogates
from tidewell.llm.common import documents, scratch, small_batches
from tidewell.llm.queries import SECRET, TOKENIZER
from tidewell.sources.fixtures import read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (8): documents predicted to have the label 0 go."""
    small_batches(spark)
    return nbsvm.good_documents(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (7): one document of each class stays, that of the smallest doc_id."""
    small_batches(spark)
    return lsh_forest.keep_one(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (4): personal data and secrets become surrogates; the number of characters follows the new text."""
    return surrogates.replace_entities(docs, SECRET).drop("kinds").withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (9): documents repeat, end early or stay out as the schedule's slots take their
    words, and are written in the order of the slots."""
    return mixing.scheduled_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (5): the pieces of all documents that are left, each with its sequence and offset."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good), ("ngram_jaccard_join", drop_near_duplicates), ("pii_surrogates", replace_private),
    ("source_mixing", mix), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    df = documents(spark, sf_dir)
    for name, stage in STAGES:
        df = scratch(stage(spark, df, sf_dir), f"pipeline-{name}")
    return df
