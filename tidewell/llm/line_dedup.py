"""Exact substring dedup by hashing lines or paragraphs.

A text is cut into units: lines (at "\\n"), or paragraphs (at empty lines). A unit's digest is the md5 of its normalised
form: lower case, punctuation and symbols dropped, white space as one space. Digests are grouped globally and the
earliest ranked occurrence, by doc_id and then by place, stays. Every other occurrence of a unit with at least
``min_words`` words is removed; its start and length in the original text (code points, with the line break that follows
it) are kept beside the shortened text.

Digests, ids and places are shuffled, never texts, to find the repeats. The first occurrence of a digest comes from an
aggregate that combines before the shuffle, so a digest in a third of all rows costs one row for each task; repeats meet
it by a join, which Spark splits when a digest is hot. Only documents that lose a unit are joined with their removals.

Defined results: null and empty texts have no units and stay as they are; units without a letter or digit are not
removed; null doc_id ranks last; rows with equal doc_id are ranked by the hash of the text, and rows that also have
equal texts are one document with one result. Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fresh, scratch, with_found

#: What normalisation drops, and the white space it folds, as Java character classes.
DROPPED, SPACE = r"[\p{P}\p{S}]+", r"[\s\p{Z}]+"
BREAKS = {"line": "\n", "paragraph": "\n\n"}


def normalised(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(unit), DROPPED, ""), SPACE, " "))


def units(docs: DataFrame, unit: str = "line", min_words: int = 5) -> DataFrame:
    """doc_id, th (hash of the text), place and digest of every unit with at least ``min_words`` words."""
    parts = docs.where(F.length("text") > 0).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", BREAKS[unit], -1)).alias("place", "unit"))
    spaces = F.length("n") - F.length(F.translate("n", " ", ""))
    return (parts.select("doc_id", "th", "place", normalised(F.col("unit")).alias("n"))
            .where((F.col("n") != "") & (spaces + 1 >= min_words)).select("doc_id", "th", "place", F.unhex(F.md5("n")).alias("digest")))


def repeats(docs: DataFrame, unit: str = "line", min_words: int = 5) -> DataFrame:
    """doc_id, th, places (sorted) of the units to be removed, one row for each document that has any."""
    found = scratch(units(docs, unit, min_words), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("th"), F.col("place"))
    firsts = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    later = found.join(firsts, "digest").where(rank != F.col("first"))
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("place")).alias("places"))


def remove_repeats(docs: DataFrame, unit: str = "line", min_words: int = 5) -> DataFrame:
    """``docs`` with the shortened ``text`` and the arrays ``removed_starts`` and ``removed_lengths``."""
    cut = BREAKS[unit]

    @F.pandas_udf("text string, starts array<long>, lengths array<long>")
    def shorten(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, places):
            if gone is None:
                out.append((None, None, None))
                continue
            parts = text.split(cut)
            sizes = np.array([len(p) + len(cut) for p in parts])
            starts = np.cumsum(sizes) - sizes
            lost = set(gone.tolist())
            out.append((cut.join(p for i, p in enumerate(parts) if i not in lost), starts[gone],
                        np.minimum(sizes[gone], len(text) - starts[gone])))
        return pd.DataFrame(out, columns=["text", "starts", "lengths"])

    met, (_, places) = with_found(docs, repeats(docs, unit, min_words), "left", ("places",))
    new = fresh(met, "_new")
    # only the texts that lose a unit go to Python
    done = met.withColumn(new, shorten(F.when(F.col(places).isNotNull(), F.col("text").cast("string")), F.col(places)))
    none = F.array().cast("array<long>")
    added = {"text": F.when(F.col(places).isNull(), F.col("text")).otherwise(F.col(new)["text"]),
             "removed_starts": F.coalesce(F.col(new)["starts"], none), "removed_lengths": F.coalesce(F.col(new)["lengths"], none)}
    return columns_of(done, docs, added)
